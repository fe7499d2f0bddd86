"""Delimited text files: inspect, read, infer types, write."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.functions.text import FILE_NULL_TOKENS, is_missing
from burnish.operators.actions import null_tokens_to_null
from burnish.operators.columns import col, groups_of, text_fields
from burnish.operators.kinds import NUMBER_PATTERN
from burnish.sources.quoted import larger_than_a_split, records
from burnish.sources.shared import written

# Delimiters looked for, in order of preference, and the two encodings.
DELIMITERS = (",", ";", "\t", "|")
DEFAULT_DELIMITER = ","
UTF8, LATIN1 = "UTF-8", "ISO-8859-1"
BOM = "﻿"

_MALFORMED = "_malformed"

# Text rules of the type inference. Numbers may be padded with ASCII spaces.
_PAD = r"[ \t\n\x0B\f\r]*"
INTEGER_PATTERN = f"^{_PAD}[+-]?[0-9]+{_PAD}$"
FLOAT_PATTERN = f"^{_PAD}{NUMBER_PATTERN[1:-1]}{_PAD}$"
INFINITY_PATTERN = f"(?i)^{_PAD}[+-]?inf(inity)?{_PAD}$"
# Boolean cells.
TRUE_CELLS, FALSE_CELLS = ("True", "TRUE", "true"), ("False", "FALSE", "false")


def inspect_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per file: (file, lines, encoding, delimiter, multi_line).

    All bytes are read once as splittable lines and every line votes, so large files are inspected
    by many tasks and each task sends a handful of numbers per file. ``encoding`` is UTF-8 if every
    line is valid UTF-8, else Latin-1. ``delimiter`` is the candidate found most often next to a
    quote; without quotes, the one whose count per line is the same on most lines; else ','.
    ``multi_line`` says that a line has an odd number of quotes, so a quoted field may span lines.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), "value")
    parted = lines.select(
        "*",
        F.replace("value", F.lit('""'), F.lit("")).alias("single_quotes"),
        F.regexp_replace("value", '"[^"]*("|$)', "").alias("unquoted"),
    )
    counts = [_occurrences(F.col("unquoted"), d) for d in DELIMITERS]
    quotes = _occurrences(F.col("value"), '"')
    votes = parted.select(
        "file",
        *[c.alias(f"count{i}") for i, c in enumerate(counts)],
        *[_beside_quotes(d).alias(f"beside{i}") for i, d in enumerate(DELIMITERS)],
        F.is_valid_utf8("value").alias("valid"),
        (quotes % 2 == 1).alias("odd"),
        (F.length("value") > 0).cast("int").alias("filled"),
        F.lit(1).alias("lines"),
    )
    sums = ["filled", "lines"]
    # Lines that look alike combine in each task before anything is shuffled.
    numbers = range(len(DELIMITERS))
    alike = votes.groupBy("file", *[f"count{i}" for i in numbers]).agg(
        *_combined(sums + [f"beside{i}" for i in numbers])
    )
    candidates = F.array(
        *[
            F.struct(
                F.lit(-i).alias("order"), F.col(f"count{i}").alias("count"), F.col(f"beside{i}").alias("beside")
            )
            for i in numbers
        ]
    )
    by_count = (
        alike.select("file", *sums, "valid", "odd", F.inline(candidates))
        .groupBy("file", "order", "count")
        .agg(*_combined([*sums, "beside"]))
    )
    usual = F.max(F.when(F.col("count") > 0, F.struct("filled", "count"))).alias("usual")
    by_candidate = by_count.groupBy("file", "order").agg(*_combined(["lines", "beside"]), usual)
    # Ties go to the preferred delimiter; a candidate that never occurs cannot win.
    found = (F.col("beside") > 0) | F.col("usual").isNotNull()
    best = F.max_by(F.when(found, F.col("order")), F.when(found, F.struct("beside", "usual", "order")))
    delimiters = F.array(*[F.lit(d) for d in DELIMITERS])
    return by_candidate.groupBy("file").agg(
        F.max("lines").alias("lines"),
        F.when(F.bool_and("valid"), UTF8).otherwise(LATIN1).alias("encoding"),
        F.coalesce(F.try_element_at(delimiters, 1 - best), F.lit(DEFAULT_DELIMITER)).alias("delimiter"),
        F.bool_or("odd").alias("multi_line"),
    )


def _beside_quotes(delimiter: str) -> Column:
    """How often the delimiter stands right before or after a quote, doubled quotes left out."""
    text = F.col("single_quotes")
    return _occurrences(text, delimiter + '"') + _occurrences(text, '"' + delimiter)


def _occurrences(text: Column, part: str) -> Column:
    without = F.replace(text, F.lit(part), F.lit(""))
    return ((F.octet_length(text) - F.octet_length(without)) / len(part)).cast("int")


def _combined(sums: list[str]) -> list[Column]:
    flags = [F.bool_and("valid").alias("valid"), F.bool_or("odd").alias("odd")]
    return [F.sum(c).alias(c) for c in sums] + flags


def file_column_names(header: list[str | None], case_sensitive: bool = True) -> list[str]:
    """Column names of a header line: blanks become 'Unnamed: i', repeats get '.1', '.2'.

    Names that differ in casing only count as repeats unless ``case_sensitive``, because Spark
    could not tell them apart.
    """
    names, taken = [], set()
    for position, raw in enumerate(header):
        base = raw if raw else f"Unnamed: {position}"
        name, suffix = base, 0
        while (name if case_sensitive else name.lower()) in taken:
            suffix += 1
            name = f"{base}.{suffix}"
        taken.add(name if case_sensitive else name.lower())
        names.append(name)
    return names


def _csv_options(sep: str, encoding: str, multi_line: bool) -> dict[str, str]:
    return {
        "sep": sep,
        "encoding": encoding,
        "multiLine": str(multi_line).lower(),
        "quote": '"',
        "escape": '"',
        "nullValue": "",
        "emptyValue": "",
        "maxCharsPerColumn": "-1",
        "maxColumns": "1000000",
    }


def _read_header(spark: SparkSession, path: str | list[str], options: dict[str, str]) -> list[str]:
    first = spark.read.options(**options).option("header", False).csv(path).limit(1).collect()
    cells = list(first[0]) if first else []
    return [(c or "").removeprefix(BOM) for c in cells]


def _usable(path: str) -> str:
    """A path as a file's metadata give it, for reading: decoded, with pattern characters escaped."""
    return re.sub(r"([\\[\]{}*?])", r"\\\1", unquote(path))


def _headers_differ(spark: SparkSession, paths: str | list[str], options: dict[str, str]) -> bool:
    """Whether the files begin with different records; two of them at most reach the driver."""
    lines = spark.read.options(**options).option("header", False).csv(paths)
    cells = F.array(*[col(c) for c in lines.columns])
    start = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    found = lines.select(F.col("_metadata.file_path").alias("file"), start.alias("at"), cells.alias("cells"))
    heads = found.groupBy("file").agg(F.min_by("cells", "at").alias("cells"))
    return len(heads.select("cells").distinct().limit(2).collect()) > 1


def _too_long(width: int, sep: str) -> Column:
    """A record Spark marks as malformed that has more cells than the header."""
    unquoted = F.regexp_replace(_MALFORMED, '(?s)"[^"]*("|$)', "")
    cells = _occurrences(unquoted, sep) + 1
    return F.col(_MALFORMED).isNotNull() & (cells > width)


def _header_cells(spark: SparkSession, header: str, options: dict[str, str]) -> list[str]:
    first = spark.read.options(**options).csv(spark.sparkContext.parallelize([header], 1)).first()
    return [c or "" for c in first] if first else []


def _read_by_blocks(spark: SparkSession, paths: str | list[str], sep: str, encoding: str, on_long_rows: str, blank_lines: bool = True) -> DataFrame:
    """Files cut into records by many tasks, also at line breaks in fields; those of different headers united by name.

    The driver sees each different header, not the files that have it. Lines of white space only are rows, as in
    Spark's reader of files with line breaks in fields, or left out without ``blank_lines``, as in the other one.
    """
    options = _csv_options(sep, "UTF-8", False)
    found = records(spark, paths, sep, encoding)
    found = found if blank_lines else found.where(F.col("header") | (F.trim("record") != ""))
    heads = written(found.where("header").select("file", F.col("record").alias("head")), "headers")
    headers = [row["head"] for row in heads.select("head").distinct().orderBy("head").collect()]  # one row per different header
    case_sensitive = spark.conf.get("spark.sql.caseSensitive") == "true"
    tables = []
    for header in headers:
        rows = found.where("NOT header")
        if len(headers) > 1:
            rows = rows.join(heads.where(F.col("head") == header).select("file").hint("broadcast"), "file", "left_semi")
        names = file_column_names(_header_cells(spark, header, options), case_sensitive)
        schema = ", ".join([*(f"c{i} STRING" for i in range(len(names))), f"{_MALFORMED} STRING"])
        cells = rows.select(F.from_csv("record", schema, options | {"columnNameOfCorruptRecord": _MALFORMED}).alias("cells")).select("cells.*")
        checked = cells if on_long_rows == "cut" else _without_long_rows(cells, len(names), sep)
        tables.append(checked.drop(_MALFORMED).toDF(*names))
    if not tables:
        return spark.createDataFrame([], T.StructType([]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def _without_long_rows(rows: DataFrame, width: int, sep: str) -> DataFrame:
    """``rows``, whose first column stands beside the malformed record, or an error for a record that is too long."""
    # Spark wants a column of the file next to the malformed one, even for a count.
    start = F.concat(F.coalesce(col(rows.columns[0]), F.lit("")), F.lit(" ..., line: "), F.col(_MALFORMED))
    message = F.concat(F.lit(f"a row has more than {width} cells: "), start)
    return rows.where(F.when(_too_long(width, sep), F.raise_error(message).cast("boolean")).otherwise(True))


def _read_group(
    spark: SparkSession, paths: str | list[str], sep: str, encoding: str, multi_line: bool, on_long_rows: str, by_blocks: bool | None
) -> DataFrame:
    if multi_line and (larger_than_a_split(spark, paths) if by_blocks is None else by_blocks):
        return _read_by_blocks(spark, paths, sep, encoding, on_long_rows)
    options = _csv_options(sep, encoding, multi_line)
    header = _read_header(spark, paths if isinstance(paths, str) else paths[0], options)
    names = file_column_names(header, spark.conf.get("spark.sql.caseSensitive") == "true")
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    # With plain names Spark compares the header of every file; else records are parted by the headers of their files.
    plain = names == header and _MALFORMED not in names
    if not plain and _headers_differ(spark, paths, options):
        return _read_by_blocks(spark, paths, sep, encoding, on_long_rows, blank_lines=multi_line)
    columns = names if plain else [f"c{i}" for i in range(len(names))]
    fields = [T.StructField(c, T.StringType()) for c in columns]
    reader = spark.read.options(**options).option("header", True).option("enforceSchema", not plain)
    if on_long_rows == "cut":
        return reader.schema(T.StructType(fields)).csv(paths).toDF(*names)
    fields.append(T.StructField(_MALFORMED, T.StringType()))
    rows = reader.schema(T.StructType(fields)).option("columnNameOfCorruptRecord", _MALFORMED).csv(paths)
    return _without_long_rows(rows, len(names), sep).drop(_MALFORMED).toDF(*names)


def _file_groups(
    spark: SparkSession, paths: str | list[str], sep: str | None, encoding: str | None, multi_line: bool | None
) -> dict[tuple[str, str, bool], str | list[str]]:
    """(delimiter, encoding, multi_line) -> paths; what is given is not looked for."""
    if None not in (sep, encoding, multi_line):
        return {(sep, encoding, multi_line): paths}
    found = inspect_files(spark, paths).select(
        "file",
        (F.lit(sep) if sep else F.col("delimiter")).alias("delimiter"),
        (F.lit(encoding) if encoding else F.col("encoding")).alias("encoding"),
        (F.col("multi_line") if multi_line is None else F.lit(multi_line)).alias("multi_line"),
    )
    kind = ["delimiter", "encoding", "multi_line"]
    stored = written(found, "files")
    kinds = stored.select(*kind).distinct().orderBy(*kind).collect()  # at most 16 rows
    if not kinds:
        return {(sep or DEFAULT_DELIMITER, encoding or UTF8, bool(multi_line)): paths}
    if len(kinds) == 1:
        return {tuple(kinds[0]): paths}
    groups: dict[tuple[str, str, bool], list[str]] = {}
    # Mixed input only: one path per file, as many as Spark's own file listing holds.
    for row in stored.orderBy("file").collect():
        groups.setdefault(tuple(row[k] for k in kind), []).append(_usable(row["file"]))
    return groups


def read_delimited(
    spark: SparkSession,
    paths: str | list[str],
    sep: str | None = None,
    encoding: str | None = None,
    *,
    multi_line: bool | None = None,
    by_blocks: bool | None = None,
    null_tokens: tuple[str, ...] | None = FILE_NULL_TOKENS,
    on_long_rows: str = "fail",
    infer: bool = False,
) -> DataFrame:
    """Read delimited text with a header. All columns are text unless ``infer``.

    What is not given is found by :func:`inspect_files`. Files that differ in delimiter, encoding or
    line breaks in fields are read in groups and united by column name; files without such line
    breaks stay splittable. Files with line breaks or odd quotes are cut into records block by block
    (:func:`burnish.sources.quoted.records`) where one is larger than a split, or with ``by_blocks``. Short rows are padded with nulls; a row longer than the header fails the
    query, or is cut with ``on_long_rows='cut'``, which also lets Spark parse only the columns in
    use. Files of a group must have the same header, which
    is checked unless the header has blank or repeated names.
    """
    if on_long_rows not in ("fail", "cut"):
        raise ValueError("on_long_rows must be 'fail' or 'cut'")
    groups = _file_groups(spark, paths, sep, encoding, multi_line)
    parts = [_read_group(spark, files, *kind, on_long_rows, by_blocks) for kind, files in groups.items()]
    table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if null_tokens:
        table = null_tokens_to_null(table, null_tokens)
    return apply_types(table, inferred_types(table)) if infer else table


def infer_types(df: DataFrame) -> DataFrame:
    """One row per text column: cell counts and the type its cells allow.

    long if all filled cells are integers, double for numbers or an empty column, boolean for
    True/False in a column without missing cells, else string. Dates stay text. One scan.
    """
    fields = text_fields(df)
    position = {name: i for i, name in enumerate(df.columns)}
    parts = [_type_counts(df, group, position) for group in groups_of(fields, 32)]
    return reduce(DataFrame.unionByName, parts)


def _type_counts(df: DataFrame, fields: list[T.StructField], position: dict[str, int]) -> DataFrame:
    # One class per cell, the cheapest tests first; then only small numbers are counted.
    classes = [_cell_class(col(f.name)).alias(f"class{i}") for i, f in enumerate(fields)]
    wanted = [F.count(F.lit(1)).alias("n")]
    for i in range(len(fields)):
        found = F.col(f"class{i}")
        wanted += [
            F.count(found).alias(f"filled{i}"),
            F.count_if(found == _INTEGER).alias(f"integers{i}"),
            F.count_if(found.isin(_INTEGER, _NUMBER)).alias(f"numbers{i}"),
            F.count_if(found == _BOOLEAN).alias(f"booleans{i}"),
        ]
    rows = []
    for i, field in enumerate(fields):
        filled = F.col(f"filled{i}")
        kind = (
            F.when(F.col("n") == 0, "string")
            .when(filled == 0, "double")
            .when(F.col(f"integers{i}") == filled, "long")
            .when(F.col(f"numbers{i}") == filled, "double")
            .when(F.col(f"booleans{i}") == F.col("n"), "boolean")
            .otherwise("string")
        )
        rows.append(
            F.struct(
                F.lit(position[field.name]).alias("position"),
                F.lit(field.name).alias("column"),
                F.col("n").alias("row_count"),
                filled.alias("filled_cells"),
                F.col(f"integers{i}").alias("integers"),
                F.col(f"numbers{i}").alias("numbers"),
                F.col(f"booleans{i}").alias("booleans"),
                kind.alias("inferred_type"),
            )
        )
    return df.select(*classes).agg(*wanted).select(F.inline(F.array(*rows)))


_TEXT, _NUMBER, _INTEGER, _BOOLEAN = 0, 1, 2, 3


def _cell_class(cell: Column) -> Column:
    """Class of a cell, null for a missing one."""
    too_big = F.length(cell) >= 19
    fits = ~too_big | F.trim(cell).try_cast("long").isNotNull()
    return (
        F.when(cell.isNull(), F.lit(None).cast("int"))
        .when(cell.isin(*TRUE_CELLS, *FALSE_CELLS), _BOOLEAN)
        .when(cell.rlike(INTEGER_PATTERN), F.when(fits, _INTEGER).otherwise(_NUMBER))
        .when(cell.rlike(FLOAT_PATTERN), _NUMBER)
        .when(cell.rlike(INFINITY_PATTERN), _NUMBER)
        .otherwise(_TEXT)
    )


def inferred_types(df: DataFrame) -> dict[str, str]:
    """Column name -> type for the text columns; runs :func:`infer_types`."""
    if not text_fields(df):
        return {}
    return {row["column"]: row["inferred_type"] for row in infer_types(df).collect()}  # one row per column


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    def typed(name: str) -> Column:
        kind, cell = types.get(name, "string"), col(name)
        if kind == "boolean":
            return cell.isin(*TRUE_CELLS)
        if kind in ("long", "double"):
            # Spark reads 'Infinity' but not 'inf' with a sign and padding alike, so name it.
            plain = F.btrim(cell, F.lit(" \t\n\x0b\f\r"))
            if kind == "double":
                negative = plain.startswith("-")
                infinity = F.when(negative, float("-inf")).otherwise(float("inf"))
                return F.when(cell.rlike(INFINITY_PATTERN), infinity).otherwise(plain.try_cast("double"))
            return plain.try_cast("long")
        return cell

    return df.select(*[typed(c).alias(c) for c in df.columns])


def write_delimited(df: DataFrame, path: str, sep: str = ",", encoding: str = UTF8) -> None:
    """Write text files with a header; null is an empty cell; quotes only where needed, doubled inside."""
    options = {
        "header": "true",
        "sep": sep,
        "encoding": encoding,
        "quote": '"',
        "escape": '"',
        "nullValue": "",
        "emptyValue": "",
        "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
        "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
    }
    if len(df.columns) == 1:
        # An empty line would be skipped by readers, so an empty cell is written as "".
        options["nullValue"] = options["emptyValue"] = '""'
    plain = df.select(
        *[F.when(~is_missing(col(f.name), f.dataType), col(f.name)).alias(f.name) for f in df.schema.fields]
    )
    plain.write.options(**options).csv(path)

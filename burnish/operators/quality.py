"""The five quality checks and the 0-100 score.

``table_facts`` computes everything the checks need in one scan and one data shuffle: every row is
expanded into one fingerprint record for the row and one per text cell; grouping the records gives
distinct rows (duplicates) and distinct normal forms (casing) at the same time. Equal records
combine before the shuffle, so a row or value that fills a third of the table costs no more than
a rare one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.functions.routing import INSTRUCTIONS
from burnish.functions.text import (
    edge_whitespace,
    header_issue,
    is_missing,
    normal_form,
    percent_text,
    priority_from_ratio,
)
from burnish.operators.columns import (
    col,
    comparable,
    groups_of,
    stacked,
    text_fields,
)

# Thresholds, weights and caps of the checks.
MISSING_MEDIUM, MISSING_HIGH = 0.05, 0.15
DUPLICATE_MEDIUM, DUPLICATE_HIGH = 0.02, 0.10
MISSING_WEIGHT, MISSING_CAP = 100.0, 35.0
DUPLICATE_WEIGHT, DUPLICATE_CAP = 120.0, 20.0
COLUMN_WEIGHT = 2.0
HEADER_CAP, WHITESPACE_CAP, CASING_CAP = 8.0, 10.0, 12.0

ROW = 0  # slot of whole-row records; text column i has slot i + 1
CHECKS = ("missing", "duplicate", "header", "whitespace", "casing")


def _missing_in_row(df: DataFrame) -> Column:
    flags = [is_missing(col(f.name), f.dataType).cast("int") for f in df.schema.fields]
    if not flags:
        return F.lit(0)
    # Added in pairs: a chain of thousands of columns would be too deep an expression.
    while len(flags) > 1:
        flags = [reduce(lambda a, b: a + b, flags[i : i + 2]) for i in range(0, len(flags), 2)]
    return flags[0]


def fingerprint(*columns: Column) -> tuple[Column, Column]:
    """128 bits: two differently seeded 64-bit hashes."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)


_RECORD = "slot:int,k1:bigint,k2:bigint,h:bigint"


def _hashable(field: T.StructField) -> Column:
    """The column for hashing; nested values as JSON, because a hash of them would skip nulls inside."""
    value = comparable(field)
    if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
        return F.when(value.isNotNull(), F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}))
    return value


def _row_fingerprint(df: DataFrame) -> tuple[Column, Column]:
    """The hash skips nulls, so null positions are hashed too."""
    values = [_hashable(f) for f in df.schema.fields]
    return fingerprint(F.lit(ROW), *values, *[v.isNull() for v in values])


def _spelling(cell: Column, edge: str) -> Column:
    """A 63-bit hash of the spelling, negative if it has edge whitespace, null for null."""
    spelling = F.shiftrightunsigned(F.xxhash64(cell), 1)
    signed = F.when(edge_whitespace(cell, edge), F.bitwise_not(spelling)).otherwise(spelling)
    return F.when(cell.isNotNull(), signed)


def _all_records(df: DataFrame, names: list[str], edge: str) -> DataFrame:
    """(slot, k1, k2, h) of each row, ``h`` being its number of missing cells, and of each cell of ``names``.

    The cells go through one expression behind the generator, so that plans grow by a name for each column.
    """
    first, second = _row_fingerprint(df)
    cells = F.array(F.lit(None).cast("string"), *[col(n) for n in names])
    long = df.select(first.alias("r1"), second.alias("r2"), _missing_in_row(df).alias("missing"), F.posexplode(cells).alias("slot", "v"))
    of_row, cell = F.col("slot") == ROW, F.col("v")
    k1, k2 = fingerprint(normal_form(cell))
    return long.select(
        "slot", F.when(of_row, F.col("r1")).otherwise(k1).alias("k1"), F.when(of_row, F.col("r2")).otherwise(k2).alias("k2"),
        F.when(of_row, F.col("missing").cast("long")).otherwise(_spelling(cell, edge)).alias("h"),
    )


def cell_record(slot: int, name: str, edge: str) -> Column:
    cell = col(name)
    first, second = fingerprint(normal_form(cell))
    return F.struct(F.lit(slot).alias("slot"), first.alias("k1"), second.alias("k2"), _spelling(cell, edge).alias("h"))


def record_groups(df: DataFrame, records: list[Column]) -> DataFrame:
    """(slot, k1, k2, n, low, high): equal rows or normal forms, with the range of their ``h``."""
    return _grouped(stacked(df, records, _RECORD))


def _grouped(records: DataFrame) -> DataFrame:
    return (
        records
        .where(F.col("h").isNotNull())
        .groupBy("slot", "k1", "k2")
        .agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
    )


def record_counts(df: DataFrame, names: list[str], edge: str) -> DataFrame:
    """(slot, k1, k2, n, low, high) of rows and of the cells of ``names``; such counts of parts of a table add up."""
    return _grouped(_all_records(df, names, edge))


def _flagged(counts: DataFrame) -> DataFrame:
    """Six numbers per group are shuffled; the flags are read off them afterwards."""
    of_rows = F.col("slot") == ROW
    return counts.select(
        "slot",
        "n",
        F.when(of_rows, F.col("n") * F.col("low")).otherwise(0).alias("missing"),
        (F.col("low") < 0).alias("edge"),
        (F.col("low") != F.col("high")).alias("varies"),
    )


def _exact_rows(df: DataFrame) -> DataFrame:
    keys = [comparable(f).alias(f"c{i}") for i, f in enumerate(df.schema.fields)]
    counted = df.select(*keys, _missing_in_row(df).alias("missing"))
    return (
        counted.groupBy(*[f"c{i}" for i in range(len(keys))])
        .agg(F.count(F.lit(1)).alias("n"), F.sum("missing").alias("missing"))
        .select(
            F.lit(ROW).alias("slot"), "n", "missing", F.lit(False).alias("edge"), F.lit(False).alias("varies")
        )
    )


def _exact_cells(df: DataFrame, slots: list[tuple[int, str]], edge: str) -> DataFrame:
    cells = [F.struct(F.lit(slot).alias("slot"), col(name).alias("v")) for slot, name in slots]
    long = stacked(df, cells, "slot:int,v:string")
    return (
        long.where(F.col("v").isNotNull())
        .groupBy("slot", normal_form(F.col("v")).alias("form"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.lit(0).cast("long").alias("missing"),
            F.bool_or(edge_whitespace(F.col("v"), edge)).alias("edge"),
            (F.min("v") != F.max("v")).alias("varies"),
        )
        .drop("form")
    )


def table_facts(df: DataFrame, edge: str = "both", exact: bool = False, cells: bool = True, counts: DataFrame | None = None) -> DataFrame:
    """One row per slot: (slot, n, groups, missing, edge, varies); slot 0 is the whole row.

    ``groups`` counts distinct rows or distinct normal forms; ``varies`` says that some normal form
    is spelled in more than one way. By default rows and values are compared by 128-bit
    fingerprints (a wrong count has odds of about 1e-15 at 1e12 rows), so 24 bytes per distinct
    row are shuffled and not the row; ``exact=True`` groups by the values themselves. Nested
    columns are compared by their JSON. ``cells=False`` leaves the text slots out. With ``counts``, what
    :func:`record_counts` gave for all parts of the table, ``df`` itself is not read.
    """
    slots = [(i + 1, f.name) for i, f in enumerate(text_fields(df))] if cells else []
    if counts is not None:
        parts = [_flagged(counts)]
    elif exact:
        parts = [_exact_rows(df)] + [_exact_cells(df, group, edge) for group in groups_of(slots)]
    else:
        parts = [_flagged(record_counts(df, [name for _, name in slots], edge))]
    grouped = reduce(DataFrame.unionByName, parts)
    return grouped.groupBy("slot").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("groups"),
        F.sum("missing").alias("missing"),
        F.bool_or("edge").alias("edge"),
        F.bool_or("varies").alias("varies"),
    )


def _columns_where(flag: str, names: list[str]) -> Column:
    slots = F.array_sort(F.collect_list(F.when((F.col("slot") != ROW) & F.col(flag), F.col("slot"))))
    if not names:
        return F.transform(slots, lambda slot: F.lit(""))
    return F.transform(slots, lambda slot: F.element_at(F.array(*[F.lit(n) for n in names]), slot))


def quality_report(df: DataFrame, edge: str = "both", exact: bool = False, counts: DataFrame | None = None) -> DataFrame:
    """One row with counts, ratios, offending columns, penalties and ``quality_score``."""
    names = [f.name for f in text_fields(df)]
    headers = [name for name in df.columns if header_issue(name)]
    of_rows = F.col("slot") == ROW
    totals = table_facts(df, edge, exact, counts=counts).agg(
        F.coalesce(F.max(F.when(of_rows, F.col("n"))), F.lit(0)).alias("row_count"),
        F.coalesce(F.max(F.when(of_rows, F.col("missing"))), F.lit(0)).alias("missing_cells"),
        F.coalesce(F.max(F.when(of_rows, F.col("n") - F.col("groups"))), F.lit(0)).alias("duplicate_rows"),
        _columns_where("edge", names).alias("whitespace_columns"),
        _columns_where("varies", names).alias("casing_columns"),
    )
    total_cells = F.greatest(F.col("row_count") * max(len(df.columns), 1), F.lit(1))
    totals = totals.select(
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        "missing_cells",
        (F.col("missing_cells") / total_cells).alias("missing_ratio"),
        "duplicate_rows",
        (F.col("duplicate_rows") / F.greatest(F.col("row_count"), F.lit(1))).alias("duplicate_ratio"),
        F.array(*[F.lit(h) for h in headers]).cast("array<string>").alias("header_columns"),
        "whitespace_columns",
        "casing_columns",
    )

    def per_column(columns: str, cap: float) -> Column:
        return F.least(F.lit(cap), F.size(columns) * COLUMN_WEIGHT)

    penalties = {
        "missing": F.least(F.lit(MISSING_CAP), F.col("missing_ratio") * MISSING_WEIGHT),
        "duplicate": F.least(F.lit(DUPLICATE_CAP), F.col("duplicate_ratio") * DUPLICATE_WEIGHT),
        "header": per_column("header_columns", HEADER_CAP),
        "whitespace": per_column("whitespace_columns", WHITESPACE_CAP),
        "casing": per_column("casing_columns", CASING_CAP),
    }
    scored = totals.select("*", *[penalties[c].alias(f"{c}_penalty") for c in CHECKS])
    penalty = reduce(lambda a, b: a + b, [F.col(f"{c}_penalty") for c in CHECKS])
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.rint(100 - penalty)))
    return scored.withColumn("quality_score", score.cast("int"))


def quality_score(df: DataFrame, edge: str = "both", exact: bool = False, counts: DataFrame | None = None) -> DataFrame:
    """One row: (row_count, missing_ratio, duplicate_ratio, n_header, n_whitespace, n_case, quality_score)."""
    return quality_report(df, edge, exact, counts).select(
        "row_count",
        "missing_ratio",
        "duplicate_ratio",
        F.size("header_columns").alias("n_header"),
        F.size("whitespace_columns").alias("n_whitespace"),
        F.size("casing_columns").alias("n_case"),
        "quality_score",
    )


def _findings(report: DataFrame) -> Column:
    """Array of the checks that fired, in check order."""
    none = F.array().cast("array<string>")
    columns = [none, none, F.col("header_columns"), F.col("whitespace_columns"), F.col("casing_columns")]
    ratio = [F.col("missing_ratio"), F.col("duplicate_ratio")] + [F.lit(None).cast("double")] * 3
    priority = [
        priority_from_ratio(F.col("missing_ratio"), MISSING_MEDIUM, MISSING_HIGH),
        priority_from_ratio(F.col("duplicate_ratio"), DUPLICATE_MEDIUM, DUPLICATE_HIGH),
        F.lit("Medium"),
        F.lit("Medium"),
        F.when(F.size("casing_columns") == 1, "Low").otherwise("Medium"),
    ]
    shape = F.format_string("%d rows and %d columns", F.col("row_count"), F.col("column_count"))
    issue = [
        F.concat(percent_text(F.col("missing_ratio")), F.lit(" of the cells in "), shape, F.lit(" are missing.")),
        F.concat(percent_text(F.col("duplicate_ratio")), F.lit(" of the rows are exact duplicates.")),
        F.lit("Some column names are not in snake_case."),
        F.lit("Some text columns have leading or trailing whitespace."),
        F.lit("Some text columns use more than one casing for the same value."),
    ]
    found = [
        F.struct(
            F.lit(check).alias("check_id"),
            columns[i].alias("columns"),
            ratio[i].alias("ratio"),
            priority[i].alias("priority"),
            F.col(f"{check}_penalty").alias("penalty"),
            issue[i].alias("issue_description"),
            F.lit(INSTRUCTIONS[check]).alias("resolution_prompt"),
        )
        for i, check in enumerate(CHECKS)
    ]
    return F.filter(F.array(*found), lambda item: item["penalty"] > 0)


def check_quality(df: DataFrame, edge: str = "both", exact: bool = False) -> DataFrame:
    """One row per check that fired, in check order (``position`` from 0)."""
    report = quality_report(df, edge, exact)
    return report.select(F.posexplode(_findings(report)).alias("position", "found")).select(
        "position", "found.*"
    )


def suggest(df: DataFrame, edge: str = "both", exact: bool = False) -> DataFrame:
    """One row: (quality_score, suggestions) with at most five suggestions."""
    report = quality_report(df, edge, exact)
    suggestions = F.transform(
        F.slice(_findings(report), 1, 5),
        lambda item: F.struct(item["issue_description"].alias("issue_description"),
                              item["priority"].alias("priority"),
                              item["resolution_prompt"].alias("resolution_prompt")),
    )
    return report.select("quality_score", suggestions.alias("suggestions"))


def edge_whitespace_cells(df: DataFrame, key: list[str], edge: str = "both") -> DataFrame:
    """(key, column, cell) for every text cell with edge whitespace. No shuffle."""
    cells = F.array(
        *[F.struct(F.lit(f.name).alias("column"), col(f.name).alias("cell")) for f in text_fields(df)]
    )
    flagged = F.filter(cells, lambda c: F.coalesce(edge_whitespace(c["cell"], edge), F.lit(False)))
    return df.select(*[col(k) for k in key], F.inline(flagged))


def column_flags(df: DataFrame, edge: str = "both", exact: bool = False) -> DataFrame:
    """One row per text column: (column, filled_cells, normal_forms, edge_whitespace, mixed_casing)."""
    names = [f.name for f in text_fields(df)]
    facts = table_facts(df, edge, exact).where(F.col("slot") != ROW)
    return facts.select(
        F.element_at(F.array(*[F.lit(n) for n in names]), F.col("slot")).alias("column"),
        F.col("n").alias("filled_cells"),
        F.col("groups").alias("normal_forms"),
        F.col("edge").alias("edge_whitespace"),
        F.col("varies").alias("mixed_casing"),
    )

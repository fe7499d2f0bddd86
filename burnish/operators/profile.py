"""Table and column profile, examples, row samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.functions.text import header_issue, is_missing, nan_to_null, snake_case_name
from burnish.operators.columns import (
    COLUMNS_PER_SCAN,
    col,
    dtype_label,
    groups_of,
    numeric_fields,
    text_fields,
)
from burnish.operators.quality import table_facts

# Limits of the profile and of the row sample.
LISTED_COLUMNS = 8
EXAMPLES = 3
SAMPLE_CELLS, SAMPLE_MIN, SAMPLE_MAX, SAMPLE_ALL = 1200, 5, 20, 50
SAMPLE_SEED = 42


def table_profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """One row: counts, missing cells and duplicate rows, ratios rounded to 4 digits."""
    totals = table_facts(df, exact=exact, cells=False).agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.max("missing"), F.lit(0)).alias("missing_cells"),
        F.coalesce(F.max(F.col("n") - F.col("groups")), F.lit(0)).alias("duplicate_rows"),
    )
    width = len(df.columns)
    cells = F.greatest(F.col("row_count") * max(width, 1), F.lit(1))
    rows = F.greatest(F.col("row_count"), F.lit(1))
    return totals.select(
        "row_count",
        F.lit(width).cast("long").alias("column_count"),
        (F.col("row_count") * max(width, 1)).alias("total_cells"),
        "missing_cells",
        F.round(F.col("missing_cells") / cells, 4).alias("missing_cell_ratio"),
        "duplicate_rows",
        F.round(F.col("duplicate_rows") / rows, 4).alias("duplicate_row_ratio"),
    )


def duplicate_stats(df: DataFrame, exact: bool = False) -> DataFrame:
    """One row: (row_count, distinct_rows, duplicate_rows, duplicate_ratio)."""
    facts = table_facts(df, exact=exact, cells=False).agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.max("groups"), F.lit(0)).alias("distinct_rows"),
    )
    duplicates = F.col("row_count") - F.col("distinct_rows")
    return facts.select(
        "row_count",
        "distinct_rows",
        duplicates.alias("duplicate_rows"),
        (duplicates / F.greatest(F.col("row_count"), F.lit(1))).alias("duplicate_ratio"),
    )


def _stats(df: DataFrame, fields: list[tuple[int, T.StructField]]) -> DataFrame:
    """One aggregate over the given columns, then one row per column."""
    wanted = [F.count(F.lit(1)).alias("n")]
    for i, field in fields:
        column = col(field.name)
        wanted.append(F.count_if(is_missing(column, field.dataType)).alias(f"missing{i}"))
        if isinstance(field.dataType, T.NumericType):
            value = nan_to_null(column, field.dataType)
            wanted += [F.min(value).alias(f"min{i}"), F.max(value).alias(f"max{i}")]
    described = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(field.name).alias("column"),
            dtype_label(field.dataType, F.col(f"missing{i}") > 0).alias("dtype"),
            F.col("n").alias("row_count"),
            F.col(f"missing{i}").alias("missing_cells"),
            (F.col(f"missing{i}") / F.greatest(F.col("n"), F.lit(1))).alias("missing_ratio"),
            _bound("min", i, field).alias("min"),
            _bound("max", i, field).alias("max"),
            F.lit(header_issue(field.name)).alias("header_issue"),
            F.lit(snake_case_name(field.name)).alias("snake_name"),
        )
        for i, field in fields
    ]
    return df.agg(*wanted).select(F.inline(F.array(*described)))


def _bound(which: str, i: int, field: T.StructField) -> Column:
    if isinstance(field.dataType, T.NumericType):
        return F.col(f"{which}{i}").cast("double") + 0.0  # -0.0 becomes 0.0
    return F.lit(None).cast("double")


def profile_columns(df: DataFrame) -> DataFrame:
    """One row per column: dtype, missing cells and unrounded ratio, numeric range, header check.

    One scan without a distinct; only one row per task is shuffled.
    """
    fields = list(enumerate(df.schema.fields))
    return reduce(DataFrame.unionByName, [_stats(df, g) for g in groups_of(fields, COLUMNS_PER_SCAN // 2)])


def missing_by_column(df: DataFrame, limit: int = LISTED_COLUMNS) -> DataFrame:
    """The columns with the highest missing ratio; columns without missing cells are left out."""
    return (
        profile_columns(df)
        .where(F.col("missing_ratio") > 0)
        .orderBy(F.col("missing_ratio").desc(), "position")
        .limit(limit)
        .select("position", "column", F.round("missing_ratio", 4).alias("missing_ratio"))
    )


def dtype_counts(df: DataFrame) -> DataFrame:
    return profile_columns(df).groupBy("dtype").agg(F.count(F.lit(1)).alias("columns"))


def numeric_ranges(df: DataFrame, limit: int = LISTED_COLUMNS) -> DataFrame:
    """Smallest and largest value of the first numeric columns; empty columns are left out."""
    kept = df.select(*[col(f.name) for f in numeric_fields(df)[:limit]])
    return profile_columns(kept).where(F.col("min").isNotNull()).select("position", "column", "min", "max")


def header_issues(df: DataFrame) -> DataFrame:
    """Columns whose name is not snake_case, with the number of cells behind each name."""
    filled = F.col("row_count") - F.col("missing_cells")
    return (
        profile_columns(df)
        .where("header_issue")
        .select("position", "column", "snake_name", filled.alias("filled_cells"))
    )


def text_samples(df: DataFrame, order_by: list[str] | None = None, limit: int = LISTED_COLUMNS) -> DataFrame:
    """The first examples of each of the first text columns: (position, column, examples).

    With ``order_by`` the examples are the first in that order; one scan serves all columns and each task
    keeps the first few of each. Without it Spark takes the first ones it meets and stops reading early.
    """
    order = order_by or []
    fields = list(enumerate(text_fields(df)[:limit]))
    if not fields:
        return df.sparkSession.createDataFrame([], "position int, column string, examples array<string>")
    keys = [f"k{i}" for i in range(len(order))]

    def cell(position: int, name: str) -> Column:
        found = [F.lit(position).alias("position"), F.lit(name).alias("column"), col(name).alias("example")]
        return F.struct(*found, *[col(k).alias(f"k{i}") for i, k in enumerate(order)])

    if order:
        cells = df.select(F.inline(F.array(*[cell(i, f.name) for i, f in fields]))).where("example is not null")
        first = Window.partitionBy("position").orderBy(*keys, "example")
        picked = cells.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= EXAMPLES).drop("nth")
    else:
        parts = [df.where(col(f.name).isNotNull()).select(F.inline(F.array(cell(i, f.name)))).limit(EXAMPLES) for i, f in fields]
        picked = reduce(DataFrame.unionByName, parts)
    ranked = F.array_sort(F.collect_list(F.struct(*keys, "example")))
    return picked.groupBy("position", "column").agg(F.transform(ranked, lambda item: item["example"]).alias("examples"))


def sample_size(width: int) -> int:
    """Rows sampled from a table of more than 50 rows."""
    return max(SAMPLE_MIN, min(SAMPLE_MAX, SAMPLE_CELLS // max(width, 1)))


def sample_rows(df: DataFrame, key: list[str] | None = None, portable: bool = False) -> DataFrame:
    """A uniform, repeatable sample: all rows up to 50, else ``sample_size`` rows.

    Rows are taken in the order of a seeded hash of ``key`` and then all columns, so the top of that
    order is all that leaves a task; no count of the table is needed. ``portable`` uses md5 of the
    text of ``key`` alone, which other engines can repeat and which must be unique for a uniform
    sample. Adds the column ``sample_rank``, which the table must not have yet.
    """
    if "sample_rank" in df.columns:
        raise ValueError("the table has a column 'sample_rank'; rename it first")
    keys = [col(k) for k in (key or df.columns)]
    if portable:
        order = F.md5(F.concat_ws("|", F.lit(str(SAMPLE_SEED)), *[k.cast("string") for k in keys]))
    else:
        order = F.xxhash64(F.lit(SAMPLE_SEED), *keys, *[col(c) for c in df.columns if key and c not in key])
    top = df.withColumn("_order", order).orderBy("_order").limit(SAMPLE_ALL + 1)
    # At most 51 rows from here on.
    everything = Window.partitionBy(F.lit(0))
    ranked = top.withColumn("sample_rank", F.row_number().over(everything.orderBy("_order"))).withColumn(
        "_found", F.count(F.lit(1)).over(everything)
    )
    keep = (F.col("_found") <= SAMPLE_ALL) | (F.col("sample_rank") <= sample_size(len(df.columns)))
    return ranked.where(keep).drop("_order", "_found")


def profile(df: DataFrame, order_by: list[str] | None = None, exact: bool = False) -> DataFrame:
    """The whole profile as one row with nested columns."""
    totals = table_profile(df, exact).select(
        "row_count", "column_count", "missing_cell_ratio", "duplicate_row_ratio"
    )
    by_missing = F.array_sort(
        F.collect_list(
            F.when(
                F.col("missing_ratio") > 0,
                F.struct(
                    (-F.col("missing_ratio")).alias("descending"),
                    "position",
                    "column",
                    F.round("missing_ratio", 4).alias("missing_ratio"),
                ),
            )
        )
    )
    first_numbers = [f.name for f in numeric_fields(df)[:LISTED_COLUMNS]]
    ranges = F.array_sort(
        F.collect_list(
            F.when(
                F.col("min").isNotNull() & F.col("column").isin(first_numbers),
                F.struct("position", "column", "min", "max"),
            )
        )
    )
    labels = F.transform(F.array_sort(F.collect_list(F.struct("position", "dtype"))), lambda x: x["dtype"])
    per_column = profile_columns(df).agg(
        labels.alias("labels"), by_missing.alias("by_missing"), ranges.alias("ranges")
    )
    distinct = F.array_distinct("labels")
    per_column = per_column.select(
        F.map_from_arrays(
            distinct, F.transform(distinct, lambda d: F.size(F.filter("labels", lambda x: x == d)))
        ).alias("dtype_counts"),
        F.transform(
            F.slice("by_missing", 1, LISTED_COLUMNS),
            lambda x: F.struct(x["column"].alias("column"), x["missing_ratio"].alias("missing_ratio")),
        ).alias("highest_missing_columns"),
        F.transform(
            "ranges",
            lambda x: F.struct(x["column"].alias("column"), x["min"].alias("min"), x["max"].alias("max")),
        ).alias("numeric_column_ranges"),
    )
    examples = text_samples(df, order_by).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "column", "examples"))),
            lambda x: F.struct(x["column"].alias("column"), x["examples"].alias("examples")),
        ).alias("text_column_samples")
    )
    # Three one-row parts with different columns become one row.
    merged = totals.unionByName(per_column, True).unionByName(examples, True)
    order = [
        "row_count", "column_count", "missing_cell_ratio", "duplicate_row_ratio", "dtype_counts",
        "highest_missing_columns", "text_column_samples", "numeric_column_ranges",
    ]
    return merged.agg(*[F.first(name, ignorenulls=True).alias(name) for name in order])

"""Column kinds from sparsity, distinct ratio and text lengths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.functions.text import strip
from burnish.functions.values import parse_date_text
from burnish.operators.columns import col, groups_of, stacked
from burnish.operators.quality import fingerprint
from burnish.sources.shared import written

NUMBER_PATTERN = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# The kinds, in the order they are tried. Shares are of the cells that are not missing.
IDENTIFIER_SHARE = 0.98
DATE_SHARE = 0.95
NUMBER_SHARE = 0.95
CATEGORY_SHARE = 0.05
NAME_LENGTH = 60
SKETCH_ERROR = 0.02
SURE = 5 * SKETCH_ERROR
# A category's values repeat in a draw of so many cells: at most this share of them is expected to differ.
DRAW, DRAW_SHARE = 100, 0.5
SAMPLE_CELLS = 20_000
DRAW_SURE = 0.03  # more than eight standard errors of the share that SAMPLE_CELLS cells give


def column_kinds(df: DataFrame, exact: bool = False, rule: str = "draw") -> DataFrame:
    """One row per column: counts, lengths and ``kind``.

    empty, identifier (almost all values differ, no blanks or fractions), date, float, category_text (values
    that repeat), name (short text), text.

    ``rule="draw"`` calls values repeated if at most half of DRAW cells drawn at random are expected to differ
    (rarefaction), which does not depend on how many rows there are; a column of fewer cells is taken whole.
    ``rule="share"`` asks for at most CATEGORY_SHARE times as many distinct values as cells instead.

    Distinct values are estimated by a sketch in the same scan. What is expected of a draw follows from a
    random sample of about SAMPLE_CELLS rows, read for columns that the counts leave open. Where an estimate lies
    so near to a threshold that its error could change the kind, and for all columns with ``exact``, 128-bit
    fingerprints are counted, which costs one shuffle.
    """
    if rule not in ("draw", "share"):
        raise ValueError("rule must be 'draw' or 'share'")
    return _by_draw(df, exact) if rule == "draw" else _by_share(df, exact)


def expected_distinct(counted: DataFrame, draw: int = DRAW) -> DataFrame:
    """(position, expected): different values among ``draw`` cells, from ``counted(position, h, n)``.

    The chance that a value of n in N cells is not drawn is the product of (N - n - i) / (N - i) over the draw.
    Values of equal counts are one term of the sum.
    """
    alike = counted.groupBy("position", "n").agg(F.count(F.lit(1)).alias("values"))
    sizes = counted.groupBy("position").agg(F.sum("n").alias("cells"))
    steps = F.sequence(F.lit(0), F.least(F.lit(draw).cast("long"), F.col("cells")).cast("int") - 1)
    missed = F.aggregate(steps, F.lit(1.0), lambda p, i: p * F.greatest(F.col("cells") - F.col("n") - i, F.lit(0)) / (F.col("cells") - i))
    terms = alike.join(sizes, "position").select("position", (F.col("values") * (1 - missed)).alias("term"))
    return terms.groupBy("position").agg(F.sum("term").alias("expected"))


def _value_counts(df: DataFrame, columns: list[tuple[int, str]]) -> DataFrame:
    """(position, h, n) of the cells that are not missing."""
    cells = [F.struct(F.lit(i).alias("position"), col(n).cast("string").alias("v")) for i, n in columns]
    filled = stacked(df, cells, "position:int,v:string").where(F.col("v").isNotNull() & (F.lower("v") != "nan"))
    return filled.groupBy("position", F.struct(*fingerprint(F.col("v"))).alias("h")).agg(F.count(F.lit(1)).alias("n"))


def _by_draw(df: DataFrame, exact: bool) -> DataFrame:
    """The kinds by share, with category, name and text told apart anew."""
    found = written(_by_share(df, exact), "kinds-by-share")
    filled = F.col("row_count") - F.col("missing_cells")
    drawn = F.least(filled, F.lit(DRAW))
    open_kinds = found.where(F.col("kind").isin("category_text", "name", "text"))
    rows = open_kinds.select("position", "column", "row_count", "distinct_values", drawn.alias("drawn")).collect()  # one per column
    # No draw has more different values than the column.
    few = {r["position"] for r in rows if r["distinct_values"] * (1 + SURE) <= DRAW_SHARE * r["drawn"]} if not exact else set()
    open_ = {r["position"]: r["column"] for r in rows if r["position"] not in few}
    categories = set(few)
    cells = {r["position"]: r["drawn"] for r in rows}

    def shares(frame: DataFrame, names: dict[int, str]) -> dict[int, float]:
        parts = [expected_distinct(written(_value_counts(frame, group), "value-counts")) for group in groups_of(list(names.items()), 32)]
        made = reduce(DataFrame.unionByName, parts).collect()  # one row per column
        return {r["position"]: r["expected"] / cells[r["position"]] for r in made}

    unsure = dict(open_)
    if open_ and not exact:
        rate = SAMPLE_CELLS / max(1, max(r["row_count"] for r in rows))
        if rate < 1:
            sampled = shares(df.where(F.rand(42) < rate), open_)
            clear = {i for i, share in sampled.items() if abs(share - DRAW_SHARE) > DRAW_SURE and cells[i] == DRAW}
            categories |= {i for i in clear if sampled[i] <= DRAW_SHARE}
            unsure = {i: n for i, n in open_.items() if i not in clear}
    if unsure:
        categories |= {i for i, share in shares(df, unsure).items() if share <= DRAW_SHARE + 1e-9}
    again = F.col("kind").isin("category_text", "name", "text")
    short = F.when(F.col("max_length") <= NAME_LENGTH, "name").otherwise("text")
    category = F.col("position").isin(*categories) if categories else F.lit(False)
    return found.withColumn("kind", F.when(again, F.when(category, "category_text").otherwise(short)).otherwise(F.col("kind")))


def _by_share(df: DataFrame, exact: bool) -> DataFrame:
    columns = list(enumerate(df.columns))
    if exact:
        return reduce(DataFrame.unionByName, [_kinds(df, group, True) for group in groups_of(columns, 32)])
    sketched = written(reduce(DataFrame.unionByName, [_kinds(df, group, False) for group in groups_of(columns, 32)]), "kinds")
    filled, estimate = F.col("row_count") - F.col("missing_cells"), F.col("distinct_values")
    unsure = [(estimate >= filled * share * (1 - SURE)) & (estimate <= filled * share * (1 + SURE)) for share in (IDENTIFIER_SHARE, CATEGORY_SHARE)]
    open_ = {row["position"] for row in sketched.where(unsure[0] | unsure[1]).select("position").collect()}  # one per column
    if not open_:
        return sketched
    counted = [_kinds(df, group, True) for group in groups_of([c for c in columns if c[0] in open_], 32)]
    return reduce(DataFrame.unionByName, [sketched.where(~F.col("position").isin(*open_)), *counted])


def _kinds(df: DataFrame, columns: list[tuple[int, str]], exact: bool) -> DataFrame:
    cells = [F.struct(F.lit(i).alias("position"), col(n).cast("string").alias("v")) for i, n in columns]
    long = stacked(df, cells, "position:int,v:string")
    value = strip(F.col("v"))
    measures = long.select(
        "position",
        F.struct(*fingerprint(F.col("v"))).alias("h"),
        F.when(F.col("v").isNotNull() & (F.lower(F.col("v")) != "nan"), value).alias("v"),
    )
    facts = [
        F.count(F.lit(1)).alias("row_count"),
        F.count("v").alias("filled"),
        F.count_if(F.col("v").rlike(NUMBER_PATTERN)).alias("numbers"),
        F.count_if(parse_date_text(F.col("v")).isNotNull()).alias("dates"),
        F.count_if(F.col("v").contains(" ")).alias("spaced"),
        F.count_if(F.col("v").rlike(r"^[+-]?[0-9]*\.[0-9]+$")).alias("fractions"),
        F.min(F.length("v")).alias("min_length"),
        F.max(F.length("v")).alias("max_length"),
    ]
    if exact:
        combined = (
            measures.groupBy("position", F.when(F.col("v").isNotNull(), F.col("h")).alias("h")).agg(*facts)
        ).groupBy("position").agg(
            *[F.sum(c).alias(c) for c in ("row_count", "filled", "numbers", "dates", "spaced", "fractions")],
            F.min("min_length").alias("min_length"),
            F.max("max_length").alias("max_length"),
            F.count("h").alias("distinct_values"),
        )
    else:
        distinct = F.approx_count_distinct(F.when(F.col("v").isNotNull(), F.col("h")["col1"]), SKETCH_ERROR)
        combined = measures.groupBy("position").agg(*facts, distinct.alias("distinct_values"))
    filled = F.col("filled")
    name = F.create_map(*[x for i, n in columns for x in (F.lit(i), F.lit(n))])
    kind = (
        F.when(filled == 0, "empty")
        .when(F.col("dates") >= filled * DATE_SHARE, "date")
        .when(
            (F.col("distinct_values") >= filled * IDENTIFIER_SHARE)
            & (F.col("spaced") == 0)
            & (F.col("fractions") == 0)
            & (filled == F.col("row_count")),
            "identifier",
        )
        .when(F.col("numbers") >= filled * NUMBER_SHARE, "float")
        .when(F.col("distinct_values") <= filled * CATEGORY_SHARE, "category_text")
        .when(F.col("max_length") <= NAME_LENGTH, "name")
        .otherwise("text")
    )
    return combined.select(
        "position",
        F.try_element_at(name, F.col("position")).alias("column"),
        "row_count",
        (F.col("row_count") - filled).alias("missing_cells"),
        "distinct_values",
        "min_length",
        "max_length",
        kind.alias("kind"),
    )

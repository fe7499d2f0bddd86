"""Connected components of a graph that may not fit in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.sources.shared import written

ROWS_PER_FILE = 500_000


def _stored(edges: DataFrame, label: str, rows: int | None) -> DataFrame:
    return written(edges if rows is None else edges.coalesce(1 + rows // ROWS_PER_FILE), label)


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row.n, row.h or 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that is not the smallest of its component; ``edges`` has two id columns.

    Alternates large and small stars: each node hands its neighbours its smallest neighbour, until nothing
    changes. The smallest neighbours are written before they are joined, so that Spark can split the
    partition of a node with very many neighbours. Rounds grow with the logarithm of the longest chain;
    the driver sees a count and a checksum per round. Edges with a null end are ignored.
    """
    a, b = (F.col(f"`{c}`") for c in edges.columns)
    oriented = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(a.isNotNull() & b.isNotNull() & (a != b))
    current = written(oriented.distinct(), "edges")
    state = _state(current)
    while state[0]:
        rows = state[0]
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low")), "low", rows)
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = _stored(large.distinct(), "large", rows)
        low = _stored(large.groupBy("u").agg(F.min("v").alias("low")), "low", rows)
        small = large.join(low, "u").where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        current = _stored(small.union(low.withColumnRenamed("low", "v")).distinct(), "edges", rows)
        before, state = state, _state(current)
        if before == state:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))

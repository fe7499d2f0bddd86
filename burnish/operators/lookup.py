"""Attach replacement values to a table by the value of a text expression.

The replacements are broadcast only after their size was measured. Larger ones are joined by a
shuffle in which frequent values and nulls are spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.operators.columns import col, quoted
from burnish.sources.shared import written

BROADCAST_BYTES = 64 * 1024 * 1024
HOT_VALUES = 1000  # at most this many values are spread
HOT_SHARE = 0.001  # a value in more than this share of the rows is hot
LANES = 32  # lanes of a hot value for each even task that its rows would fill; more are more even


def row_bytes(df: DataFrame) -> Column:
    """Upper bound of the in-memory size of a row; nested values count by their JSON, four times."""
    size = F.lit(64 + 16 * len(df.columns))
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(col(field.name)), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            size = size + 4 * F.coalesce(F.octet_length(F.to_json(F.struct(col(field.name)), {"ignoreNullFields": "false"})), F.lit(0))
    return size


def measured_bytes(mapping: DataFrame) -> DataFrame:
    """(slot, bytes) of each slot's replacements."""
    return mapping.groupBy("slot").agg(F.sum(row_bytes(mapping)).alias("bytes"))


def hot_values(df: DataFrame, name: str, at_least: int = 0) -> DataFrame:
    """Up to HOT_VALUES frequent values of a column, one sketch per task, no shuffle of the rows.

    The sketch may miss or add a value at the margin; that changes the spread, never the result.
    """
    top = F.expr(f"approx_top_k({quoted(name)}, {HOT_VALUES}, {HOT_VALUES * 10})")
    sketched = df.agg(top.alias("top"), F.count(F.lit(1)).alias("n"))
    return (
        sketched.select("n", F.inline("top"))
        .where(F.col("count") > F.greatest(F.col("n") * HOT_SHARE, F.lit(at_least)))
        .select(F.col("item").alias("_hot"))
        .where(F.col("_hot").isNotNull())
    )


def lanes_of(df: DataFrame, name: str) -> DataFrame:
    """(_hot, _lanes): how many lanes each frequent value of a column, null too, is spread over.

    A lane holds about a LANES-th of what an even task of the shuffle would, whatever the value's share of the
    rows is, so that tasks come out even.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    top = F.expr(f"approx_top_k({quoted(name)}, {HOT_VALUES}, {HOT_VALUES * 10})")
    counted = df.agg(top.alias("top"), F.count(F.lit(1)).alias("n"), F.count_if(col(name).isNull()).alias("nulls"))
    nulls = F.array(F.struct(F.lit(None).cast(df.schema[name].dataType).alias("item"), F.col("nulls").alias("count")))
    values = F.filter("top", lambda x: x["item"].isNotNull())
    every = counted.select("n", F.inline(F.concat(values, nulls)))
    lanes = F.ceil(F.col("count") * tasks * LANES / F.col("n")).cast("int")
    return every.where(F.col("count") > F.col("n") * HOT_SHARE).select(F.col("item").alias("_hot"), lanes.alias("_lanes"))


def _spread_join(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Left join on _probe = _key; rows with a hot or null probe go to as many lanes as their number asks for.

    The lanes are written first, because both sides must agree on them. A row's lane comes from the number of its
    partition and its cells, so a task that runs again after a loss deals its rows the same way, in any order.
    """
    hot = written(lanes_of(df, "_burnish_probe"), "hot")
    cells = [col(f.name) for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    lane = F.pmod(F.xxhash64(F.spark_partition_id(), *cells), F.col("_lanes")) + 1
    left = (
        df.join(F.broadcast(hot), F.col("_burnish_probe").eqNullSafe(F.col("_hot")), "left")
        .withColumn("_salt", F.when(F.col("_lanes").isNotNull(), lane).otherwise(0).cast("int"))
        .drop("_hot", "_lanes")
    )
    copies = F.when(F.col("_lanes").isNotNull(), F.sequence(F.lit(1), F.col("_lanes"))).otherwise(F.array(F.lit(0)))
    right = (
        mapping.join(F.broadcast(hot), F.col("_burnish_key") == F.col("_hot"), "left")
        .withColumn("_copy", F.explode(copies))
        .drop("_hot", "_lanes")
    )
    same = (F.col("_burnish_probe") == F.col("_burnish_key")) & (F.col("_salt") == F.col("_copy"))
    return left.join(right.hint("merge"), same, "left").drop("_salt", "_copy")


def attach(df: DataFrame, probe: Column, mapping: DataFrame, mapping_bytes: int, out: str) -> DataFrame:
    """Left join of ``mapping(_burnish_key, ...)``, unique in ``_key``, on ``probe`` as the struct column ``out``."""
    values = [F.col(c) for c in mapping.columns if c != "_burnish_key"]
    packed = mapping.select("_burnish_key", F.struct(*values).alias(out))
    probed = df.withColumn("_burnish_probe", probe)
    if mapping_bytes <= BROADCAST_BYTES:
        joined = probed.join(F.broadcast(packed), F.col("_burnish_probe") == F.col("_burnish_key"), "left")
    else:
        joined = _spread_join(probed, packed)
    return joined.drop("_burnish_probe", "_burnish_key")

"""A Bloom filter as a small table of bitmaps: which rows may have a partner, told before anything is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.sources.shared import written

PAGE_BITS = 32768  # bits of one bitmap of Spark's
MOST_BITS = 1 << 29  # 64 MB, whatever the number of keys
BITS_FOR_EACH_KEY = 16


def bloom_filter(keys: DataFrame, n_keys: int, hashes: list[str], most_bits: int = MOST_BITS) -> tuple[DataFrame, int]:
    """((page, bits), number of bits) of ``keys``, whose columns ``hashes`` are hashes of 64 bits each.

    Every hash sets a bit. With 16 bits for each key and two hashes one key in 70 that is not there passes; the
    filter never grows beyond ``most_bits``, where 10^8 keys let one in ten pass.
    """
    n_bits = -(-min(most_bits, max(1, n_keys * BITS_FOR_EACH_KEY)) // PAGE_BITS) * PAGE_BITS
    bit = F.explode(F.array(*[F.pmod(F.col(h), F.lit(n_bits)) for h in hashes])).alias("bit")
    paged = keys.select(bit).select(F.expr(f"bit div {PAGE_BITS}").alias("page"), F.pmod("bit", F.lit(PAGE_BITS)).alias("at"))
    return written(paged.groupBy("page").agg(F.bitmap_construct_agg(F.col("at")).alias("bits")), "bloom"), n_bits


def _is_set(bits: Column, at: Column) -> Column:
    octet = F.conv(F.hex(F.substring(bits, F.expr("1").cast("int") + (at / 8).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.bit_get(octet, F.pmod(at, F.lit(8)).cast("int")) == 1


def may_be_in(df: DataFrame, hashes: list[str], bloom: DataFrame, n_bits: int) -> DataFrame:
    """The rows of ``df`` whose hashes all stand in the filter, which is broadcast: its size has a bound."""
    for h in hashes:
        bit = F.pmod(F.col(h), F.lit(n_bits))
        page = F.broadcast(bloom.toDF("_page", "_bits"))
        placed = df.withColumn("_bit", bit)
        joined = placed.join(page, F.expr(f"_bit div {PAGE_BITS}") == F.col("_page"))
        df = joined.where(_is_set(F.col("_bits"), F.pmod("_bit", F.lit(PAGE_BITS)))).drop("_bit", "_page", "_bits")
    return df

"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source's share of all words is filled by complete epochs of the source and then by a fraction of it. For
the fraction every document draws an exponential key divided by its quality weight; keys are sorted within
the source and sizes summed up to what is left of the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from burnish.llm.common import sized
from burnish.operators.columns import col
from burnish.sources.shared import written

MOST_EPOCHS = 3
WEIGHTS = 3  # sources weigh 1, 2, ... WEIGHTS in turn
WORD = r"[^\x20\x09-\x0D]+"
NOT_PROSE = r"[^\p{L}\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_of(text: Column) -> Column:
    """10 for prose down to 1: a point less for each 2 % of characters that are neither letters nor white space."""
    odd = F.length(text) - F.length(F.regexp_replace(text, NOT_PROSE, ""))
    points = 10 - F.floor(50 * odd / F.greatest(F.length(text), F.lit(1)))
    return F.coalesce(F.greatest(points, F.lit(1)), F.lit(1)).cast("int")


def exponential_key(doc_id: Column, quality: Column, seed: str) -> Column:
    """-ln(u) / quality with u from the id alone, so that every run draws the same."""
    digits = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":" + seed)).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.ln(u) / quality


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source_key, source_size, target): the shares by weight, none above MOST_EPOCHS times its source.

    Sharing the excess again and again ends at min(cap, level * weight) with one level for all. Sources are
    sorted by cap over weight; the level is set by the first source that is not capped at the level that it
    and all later ones would share, which is the largest such level. One row per source, so the unpartitioned windows are over sources only.
    """
    totals = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source_key").asc_nulls_last())
    weighed = totals.select(
        "*",
        (1 + (F.row_number().over(order) - 1) % WEIGHTS).alias("weight"),
        (MOST_EPOCHS * F.col("source_size")).alias("cap"),
    )
    ranked = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source_key"))
    before, after = ranked.rowsBetween(Window.unboundedPreceding, -1), ranked.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    levels = weighed.withColumn("level", level)
    levels = levels.withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(everything))
    target = F.least(F.col("cap").cast("double"), F.coalesce("level", F.lit(0.0)) * F.col("weight"))
    return levels.select("source_key", "source_size", target.alias("target"))


def mixture(docs: DataFrame, keep: list[str] | None = None, seed: str = "mix") -> DataFrame:
    """(row, size, source_size, target, taken) of every row of ``docs(doc_id, text, source, ...)``.

    ``row`` holds the columns ``keep`` (all by default) of the input, so no name can clash. Size is the number
    of words, 0 for null. A source takes ``floor(target / source_size)`` whole epochs and then, in the order of
    the keys, the documents whose middle word still lies within the rest: whole documents, so that the mix is
    within half a document of its target. Null sources are one source, the last; ties go by doc_id, then size.
    Rows that repeat an id draw the same key. An empty table gives no rows, a source without words takes none.

    Sums run over narrow rows only: one range shuffle splits the hot source, each part is summed up by itself and
    parts are added up by source. As the sums before a document only rise, what a source takes in part is all up
    to one document in the order of the keys; rows are compared with that one where they lie.
    """
    kept = F.struct(*[col(c) for c in keep or docs.columns]).alias("row")
    source_key = F.when(F.col("source").isNotNull(), F.col("source").cast("string")).alias("source_key")
    tie = F.col("doc_id").cast("long")
    place = F.struct(
        exponential_key(F.col("doc_id"), quality_of(F.col("text")), seed).alias("key"),
        tie.isNull().alias("no_id"), tie.alias("tie"), size_of(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("number"),
    )
    measured = written(docs.select(kept, source_key, place.alias("place")), "measured")
    narrow = measured.select("source_key", "place", F.col("place.size").alias("size"))
    targets = written(source_targets(narrow), "targets")
    ordered = narrow.repartitionByRange(F.col("source_key").asc_nulls_last(), "place")
    ordered = written(ordered.withColumn("part", F.spark_partition_id()), "ordered")
    before = Window.partitionBy("source_key", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("source_key", "part").agg(F.sum("size").alias("size"))
    earlier = Window.partitionBy("source_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source_key", "part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("base"))
    parts = parts.alias("p").join(sized(targets).alias("t"), F.col("p.source_key").eqNullSafe(F.col("t.source_key")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - epochs * F.col("source_size")
    parts = written(parts.select("p.source_key", "part", "base", "source_size", "target", epochs.alias("epochs"), rest.alias("rest")), "parts")
    summed = ordered.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    same = F.col("s.source_key").eqNullSafe(F.col("p.source_key")) & (F.col("s.part") == F.col("p.part"))
    fits = F.col("base") + F.col("before") + F.col("size") / 2 <= F.col("rest")
    last = F.max(F.when(fits, F.col("place"))).alias("last")
    facts = ["source_size", "target", "epochs"]
    cuts = summed.alias("s").join(sized(parts).alias("p"), same).groupBy("s.source_key", *facts).agg(last)
    cuts = written(cuts.select(F.col("source_key").alias("cut_key"), *facts, "last"), "cuts")
    joined = measured.join(sized(cuts), F.col("source_key").eqNullSafe(F.col("cut_key")))
    more = F.coalesce((F.col("place") <= F.col("last")).cast("long"), F.lit(0))
    size = F.col("place.size")
    return joined.select("row", size.alias("size"), "source_size", "target", ((F.col("epochs") + more) * size).cast("long").alias("taken"))


MIX_SQL = r"""
WITH measured AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln(((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':mix'), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0)
      / coalesce(greatest(10 - floor(50.0::DOUBLE * (length(text) - length(regexp_replace(text, '[^\p{L}\x20\x09-\x0D]+', '', 'g')))
        / greatest(length(text), 1)), 1), 1) AS key
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM measured GROUP BY source),
weighed AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS cap FROM totals),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
  FROM weighed WINDOW r AS (ORDER BY cap::DOUBLE / weight, source)),
targets AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce(max(CASE WHEN level <= cap::DOUBLE / weight THEN level END) OVER (), 0) * weight) AS target
  FROM levels),
ordered AS (
  SELECT m.doc_id, m.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
    coalesce(sum(m.size) OVER (PARTITION BY m.source ORDER BY key, m.doc_id, m.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM measured m JOIN targets t ON m.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  ((epochs + CASE WHEN before + size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM ordered
"""

"""Line dedup: lines that many documents hold leave all of them.

Lines are normalised, hashed to 128 bits and counted by document; those over the threshold are dropped and the
rest is put together again by position. DataFrame operations only.
"""

from __future__ import annotations

from functools import reduce
from operator import and_
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.llm.common import sized
from burnish.operators import lookup
from burnish.operators.columns import col
from burnish.sources.shared import written

LEAST_DOCUMENTS = 10
LEAST_LENGTH = 1  # code points of a key
SPACE = " \t\n\x0b\f\r"
HASHES = ("h1", "h2")
ROW_KEYS = ("k1", "k2")


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is; texts of one byte a character take the short way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, ascii_uppercase, ascii_lowercase)
    )


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _line_hashes(text: Column, least_length: int) -> Column:
    """A 128-bit hash of each line's key, null for a key that is too short."""

    def hashed(line: Column) -> Column:
        key = F.btrim(line, F.lit(SPACE))
        pair = F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit(1)).alias("h2"))
        return F.when(F.length(key) >= least_length, pair)

    return F.transform(split_lines(lowered(text)), hashed)


def without_common_lines(
    docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, least_length: int = LEAST_LENGTH
) -> DataFrame:
    """(row, kept, n_lines, n_dropped) of every row of ``docs(doc_id, text, ...)``.

    ``row`` holds all columns of the input, so no name can clash; ``kept`` is the text without its common lines.
    A text is cut at each line feed; a null or empty one is one empty line, and a text that loses all lines is
    empty. A line's key is the line without ASCII white space at both ends, A-Z in lower case. Keys of
    ``least_length`` code points or more that stand in at least ``least_documents`` documents lose all their
    lines. Rows that repeat a doc_id are one document in these counts; rows without one count as a document for
    each different text. Every row is cut by itself. An empty table gives no rows.

    Each row sends every key once, and tasks combine the counts, so a line in a third of all documents costs a
    record per task. Documents are only told apart for keys that enough rows hold. No text is shuffled while
    what is dropped is small enough to be broadcast; beyond that texts are shuffled once, by a hash of the row.
    """
    anonymous = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    row_keys = [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id", F.lit(1)).alias("k2")]
    lines = _line_hashes(F.col("text"), least_length).alias("lines")
    marked = written(docs.select(*row_keys, "doc_id", anonymous.alias("anonymous"), lines), "lines")

    each = marked.select(F.explode(F.array_distinct("lines")).alias("h")).where("h is not null").select("h.*")
    often = each.groupBy(*HASHES).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_documents)
    often = written(often.select(*HASHES), "often")
    placed = marked.select(*ROW_KEYS, "doc_id", "anonymous", F.posexplode("lines").alias("pos", "h")).where("h is not null")
    held = written(placed.select(*ROW_KEYS, "doc_id", "anonymous", "pos", "h.*").join(sized(often), list(HASHES), "left_semi"), "held")
    documents = held.groupBy(*HASHES, "doc_id", "anonymous").agg(F.lit(1).alias("one")).groupBy(*HASHES).agg(F.sum("one").alias("n"))
    common = written(documents.where(F.col("n") >= least_documents).select(*HASHES), "common")
    # Equal rows have equal keys and positions, which combine in each task.
    dropped = held.join(sized(common), list(HASHES), "left_semi").groupBy(*ROW_KEYS).agg(F.collect_set("pos").alias("places"))
    dropped = written(dropped, "dropped")
    size = dropped.agg(F.sum(F.lit(64) + 4 * F.size("places"))).first()[0] or 0
    places = dropped.toDF("_p1", "_p2", "places")
    places = F.broadcast(places) if size <= lookup.BROADCAST_BYTES else places.hint("merge")

    row = F.struct(*[col(c) for c in docs.columns]).alias("row")
    rows = docs.select(row, "text", *row_keys)
    joined = rows.join(places, reduce(and_, [F.col(k) == F.col(p) for k, p in zip(ROW_KEYS, ("_p1", "_p2"), strict=True)]), "left")
    split = joined.select("row", split_lines(F.col("text")).alias("lines"), "places")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("places", F.array().cast("array<int>")))
    kept = F.when(F.col("places").isNull(), F.array_join("lines", "\n")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n")
    )
    return split.select(
        "row",
        kept.alias("kept"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
    )


LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
common AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT l.*, c.key IS NOT NULL AS gone FROM lines l LEFT JOIN common c ON l.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

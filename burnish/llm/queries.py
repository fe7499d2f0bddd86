"""The registered queries of the training-data operators and, where SQL can express them, their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.llm import (
    divergence, language, licenses, lines, mixing, mtree, packing, passages, quality, simhash, spelling, toxicity, warc,
)
from burnish.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECK_SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


@query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.scores(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mixing.mixture(docs, keep=["doc_id"]).select("row.doc_id", "size", "source_size", "target", "taken")


CHECK_SQL["op6_mixing"] = mixing.MIX_SQL

TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


@query
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licensed(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op8_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = warc.archived(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return entries.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents", "text", "lang", "source"))


@query
def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.without_common_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return cut.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents", "doc_id", "text"))


CHECK_SQL["op11_divergence"] = divergence.DIVERGENCE_SQL
CHECK_SQL["op12_lines"] = lines.LINES_SQL
CHECK_SQL["op13_spelling"] = spelling.SPELLING_SQL
CHECK_SQL["op8_mtree"] = TOPK_SQL
CHECK_SQL["op9_warc"] = WARC_SQL

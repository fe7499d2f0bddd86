"""A corpus from raw documents to packed sequences: STAGES one by one, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.llm import language, mixing, packing, passages, simhash
from burnish.llm.common import DOCUMENT_COLUMNS
from burnish.sources.shared import new_path

ORACLE_SQL = None  # compression and token ids are beyond SQL; tests/llm/test_pipeline.py holds a plain version


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language stays unclear: without a letter, or with too narrow a margin."""
    return language.with_known_language(docs).select(*DOCUMENT_COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    return simhash.first_of_each(docs).select(*DOCUMENT_COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document holds; documents that were cut down to nothing go."""
    cut = passages.without_repeats(docs.select(*DOCUMENT_COLUMNS))
    cut = cut.withColumn("n_chars", F.length("text").cast("long"))
    return cut.where(F.col("text").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that each source gets its share of the words."""
    mixed = mixing.mixture(docs.select(*DOCUMENT_COLUMNS))
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(1).cast("int")
    repeated = mixed.select("row", F.explode(F.array_repeat(F.lit(0), times)).alias("_"))
    return repeated.select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in the packed sequences."""
    return packing.packed(docs)


STAGES = [
    ("language", tell_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each returns is written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

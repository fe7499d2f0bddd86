"""The quality score of a table that grows by files: each file is scanned once.

What a scan leaves behind are counted fingerprints of rows and of the cells' normal forms. These add up over files,
so they are stored for each batch of new files and put together for the score.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.operators import quality
from burnish.operators.columns import text_fields
from burnish.sources.shared import complete_folders, remove_folder

MOST_BATCHES = 32  # batches that are read for a score; beyond that they are put together in one
FILE = ["path", "length", "modificationTime"]

Reader = Callable[[list[str]], DataFrame]


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder, from the listing alone."""
    return spark.read.format("binaryFile").load(folder).select(*FILE)


def _merged(parts: list[DataFrame]) -> DataFrame:
    sums = [F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")]
    return reduce(DataFrame.unionByName, parts).groupBy("slot", "k1", "k2").agg(*sums)


def _described(df: DataFrame, edge: str) -> str:
    return f"{edge} {df.schema.simpleString()}"


def update(spark: SparkSession, folder: str, store: str, reader: Reader | None = None, edge: str = "both") -> DataFrame:
    """(slot, k1, k2, n, low, high) over all files of ``folder``; only files that are new to ``store`` are read.

    ``reader`` makes a table of a list of paths (Parquet without it). The store holds a folder of counts for each
    batch of files and manifests that name each file's batch. A manifest is written last and whole, so an update that
    breaks off leaves the last one in force. If a known file has gone or changed, or the columns have, all files are
    scanned anew. One update at a time: two at once would both scan, and the later manifest would win.

    The driver gets the paths of the new files, which it hands to the reader, and a name for each batch.
    """
    reader = reader or (lambda paths: spark.read.parquet(*paths))
    files = _listed(spark, folder)
    manifests = complete_folders(spark, f"{store}/manifest-*")
    known = spark.read.parquet(manifests[-1]) if manifests else None
    if known is not None and known.join(files, FILE, "left_anti").limit(1).count():
        known = None
    new = files if known is None else files.join(known, FILE, "left_anti")
    paths = sorted(row["path"] for row in new.select("path").collect())
    schema = None
    if paths:
        df = reader(paths)
        schema = _described(df, edge)
        if known is not None and known.where(F.col("schema") != schema).limit(1).count():
            known, new = None, files
            paths = sorted(row["path"] for row in files.select("path").collect())
            df = reader(paths)
            schema = _described(df, edge)
    elif known is None:
        raise ValueError(f"no files in {folder}")
    elif not known.where(F.col("schema").startswith(f"{edge} ")).limit(1).count():
        raise ValueError("the store holds counts for another 'edge'; use a store of its own")
    batches = [] if known is None else sorted(row["batch"] for row in known.select("batch").distinct().collect())
    if paths:
        batch = uuid.uuid4().hex
        groups = quality.record_counts(df, [f.name for f in text_fields(df)], edge)
        merge = len(batches) >= MOST_BATCHES
        if merge:
            groups = _merged([groups, *_stored(spark, store, batches)])
        groups.write.parquet(f"{store}/counts-{batch}")
        told = new.select(*FILE, F.lit(schema).alias("schema"), F.lit(batch).alias("batch"))
        if known is not None:
            told = told.unionByName(known.withColumn("batch", F.lit(batch)) if merge else known)
        told.write.parquet(f"{store}/manifest-{len(manifests) and int(manifests[-1][-12:]) + 1:012d}")
        for old in manifests[:-1]:  # the last one may be in use
            remove_folder(spark, old)
        batches = [batch] if merge else [*batches, batch]
    return _merged(_stored(spark, store, batches))


def _stored(spark: SparkSession, store: str, batches: list[str]) -> list[DataFrame]:
    return [spark.read.parquet(f"{store}/counts-{batch}") for batch in batches]


def quality_score(spark: SparkSession, folder: str, store: str, reader: Reader | None = None, edge: str = "both") -> DataFrame:
    """The score of all files of ``folder`` (see :func:`burnish.operators.quality.quality_score`), by ``update``."""
    counts = update(spark, folder, store, reader, edge)
    shape = (reader or (lambda paths: spark.read.parquet(*paths)))([folder])
    return quality.quality_score(shape, edge, counts=counts)

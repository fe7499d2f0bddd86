"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

RUN = uuid.uuid4().hex[:12]  # part of the names of all tables that this process writes
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_writers: weakref.WeakKeyDictionary[SparkSession, tuple[int, str]] = weakref.WeakKeyDictionary()
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="burnish-")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Only a local session without both gets a folder of its own; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    return _local_folder()


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/burnish-{RUN}-{label}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The setting that removes shuffle files is on while any thread of the session writes."""
    with _lock:
        writers, before = _writers.get(spark, (0, spark.conf.get(_CLEANUP, "false")))
        _writers[spark] = writers + 1, before
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            writers, before = _writers.pop(spark)
            if writers > 1:
                _writers[spark] = writers - 1, before
            else:
                spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` computed once into a shared table, so later uses neither repeat nor lose it.

    What was shuffled for it is of no more use then, and Spark is told to remove those files at once.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    with _shuffles_removed(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def _delete(spark: SparkSession, pattern: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in files.globStatus(path) or []:
        files.delete(found.getPath(), True)


def complete_folders(spark: SparkSession, pattern: str) -> list[str]:
    """The folders of a pattern that a job wrote to its end, in the order of their names."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    files = done.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(found.getPath().getParent().toString() for found in files.globStatus(done) or [])


def remove_folder(spark: SparkSession, path: str) -> None:
    _delete(spark, path)


def forget(*tables: DataFrame) -> None:
    """Remove tables that ``written`` returned and that nothing will read any more."""
    for table in tables:
        _delete(table.sparkSession, _paths.pop(table))


def remove_tables(spark: SparkSession) -> None:
    """Remove all intermediate tables of this process, once none of its results will be computed any more."""
    _delete(spark, f"{shared_folder(spark)}/burnish-{RUN}-*")

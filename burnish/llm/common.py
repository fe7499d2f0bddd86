"""What the operators share: reading tables, words, and the split into learning and held-out rows."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.operators import lookup

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def sized(stored: DataFrame) -> DataFrame:
    """A stored table as a side of a join: broadcast if its measured rows allow, else to be sorted and merged.

    Spark itself would go by the bytes of the compressed files, which say little about the rows.
    """
    size = stored.agg(F.sum(lookup.row_bytes(stored))).first()[0] or 0
    return F.broadcast(stored) if size <= lookup.BROADCAST_BYTES else stored.hint("merge")


def words(text: str | None) -> list[bytes]:
    """Runs of characters other than ASCII white space, as UTF-8. ``bytes.split`` cuts at x09-x0D and x20 only."""
    return text.encode().split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """``words`` with A-Z in lower case; ``bytes.lower`` leaves all other characters alone."""
    return text.encode().lower().split() if text else []


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_BYTES = np.random.default_rng(20).integers(1, 1 << 64, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}
CHUNK = 1 << 22  # bytes that are hashed at a time


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads small differences over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    found = _powers.get(base)
    if found is None or len(found) < n:
        found = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        found[0] = 1
        _powers[base] = found = np.multiply.accumulate(found)
    return found[:n]


def _give_back() -> None:
    """What a Python worker keeps for later goes back to the system: workers wait idle beside each other."""
    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def lean(rows: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``rows`` over a task's batches, after which the worker keeps no more than it needs."""

    @wraps(rows)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from rows(batches)
        finally:
            _give_back()

    return wrapped


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of UTF-8 text starts and ends, in bytes."""
    space = np.concatenate(([True], _SPACE[np.frombuffer(data, dtype=np.uint8)], [True]))
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2]


def word_hashes(text: str | None, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, in order: a polynomial over its bytes, from running sums over the text.

    Equal words have equal hashes; A-Z count as a-z if ``lower``.
    """
    data = text.encode() if text else b""
    data = data.lower() if lower else data
    parts = []
    while data:
        head, data = data[:CHUNK], data[CHUNK:]
        if data and not _SPACE[head[-1]]:  # up to the end of the word
            rest = data.split(None, 1)[0] if not _SPACE[data[0]] else b""
            head, data = head + rest, data[len(rest) :]
        starts, ends = word_bounds(head)
        octets = np.frombuffer(head, dtype=np.uint8)
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTES[octets] * _power(_BASE, len(octets)))))
        inverse = _power(pow(_BASE, -1, 1 << 64), len(octets) + 1)
        parts.append(mixed((sums[ends] - sums[starts]) * inverse[starts]))
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` words."""
    many = max(0, len(words) - n + 1)
    found = words[:many].copy()
    for k in range(1, n):
        found = found * np.uint64(_BASE) ^ words[k : k + many]
    return mixed(found)


def word_count(text: Column) -> Column:
    """The number of ``words`` of a text, 0 for null."""
    bare = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.regexp_replace(bare, r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Rows that a model must not learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))

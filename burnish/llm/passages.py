"""Repeated passages: compact windows of min-hashes propose them, shingle counts verify them.

A text is its sequence of five-word shingles. For a hash function the Cartesian tree over the hashes splits
all its subsequences into compact windows: the subsequences between a and b that hold position c have the
hash at c as their min-hash. Only windows that hold a subsequence of the least length are kept, about two for
each such length of text. Passages with similarity s share a window's min-hash with chance s for each hash
function, equal ones always. So signatures found in two documents propose the intervals of their windows;
the intervals of all hash functions are joined, and every shingle in them is counted across documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.llm.common import lean, mixed, shingle_hashes, word_hashes
from burnish.operators.columns import col
from burnish.sources.shared import forget, written

SHINGLE = 5
LEAST_WORDS = 50
SIMILARITY = 0.8
HASHES, ENOUGH = 4, 2  # at least two of four are shared with chance 0.97 at Jaccard 0.8, 0.89 at share 0.8 (0.67)
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
WORD_AND_SPACE = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def shingles_of(text: str | None) -> np.ndarray:
    return shingle_hashes(word_hashes(text), SHINGLE)


def compact_windows(hashes: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(a, c, b) of the windows of at least ``least`` positions, from the top of the Cartesian tree."""
    found, open_ = [], [(0, len(hashes) - 1)] if len(hashes) >= least else []
    while open_:
        a, b = open_.pop()
        c = a + int(hashes[a : b + 1].argmin())
        found.append((a, c, b))
        if c - a >= least:
            open_.append((a, c - 1))
        if b - c >= least:
            open_.append((c + 1, b))
    return found


def sliding_minima(hashes: np.ndarray, least: int) -> np.ndarray:
    """The least hash of every ``least`` positions in a row: prefix minima of blocks meet suffix minima.

    These are the signatures of exactly the compact windows with at least ``least`` positions.
    """
    n = len(hashes)
    padded = np.full(-(-n // least) * least, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = hashes
    blocks = padded.reshape(-1, least)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - least + 1], ahead[least - 1 : n])


def _hashed(shingles: np.ndarray) -> Iterator[np.ndarray]:
    """The hashes of the shingles by each of the hash functions."""
    return (mixed(shingles ^ np.uint64(seed)) for seed in SEEDS[:HASHES])


def similar_stretches(shared: np.ndarray, least: int, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Maximal stretches (start, end) of at least ``least`` positions that begin and end in shared ones and of
    whose positions at least ``similarity`` are shared, whatever their gaps.

    Each such stretch lies in one of those returned, none of which lies in another; they may overlap, where their
    union has too small a share. Starts and ends rise. With the sums of (shared - similarity) up to each position,
    a start reaches the last end whose sum is not less.
    """
    parts = Fraction(similarity).limit_denominator(1000)  # whole numbers, so that a share of exactly 0.8 counts
    sums = np.concatenate(([0], np.cumsum(np.where(shared, parts.denominator, 0) - parts.numerator)))
    before, after = np.concatenate(([False], shared)), np.concatenate((shared, [False]))
    starts, ends = np.flatnonzero(after & ~before), np.flatnonzero(before & ~after)
    if not len(starts):
        return []
    highest = np.maximum.accumulate(sums[ends][::-1])  # from the last end backwards
    reached = ends[len(ends) - 1 - np.searchsorted(highest, sums[starts])]
    new = np.concatenate(([True], reached[1:] > np.maximum.accumulate(reached)[:-1]))
    chosen = new & (reached - starts >= least)
    return list(zip(starts[chosen].tolist(), reached[chosen].tolist(), strict=True))


def _signature_rows(least: int):
    @lean
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, signatures = [], []
            for doc_id, text in zip(batch["doc_id"].to_numpy(), batch["text"], strict=True):
                shingles = shingles_of(text)
                if len(shingles) < least:
                    continue
                found = np.unique(np.concatenate([sliding_minima(h, least) for h in _hashed(shingles)]))
                signatures.append(found.view(np.int64))
                ids.append(np.full(len(found), doc_id, dtype=np.int64))
            if ids:
                yield pd.DataFrame({"signature": np.concatenate(signatures), "doc_id": np.concatenate(ids)})

    return rows


def proposed(shingles: np.ndarray, signatures: np.ndarray, least: int) -> np.ndarray:
    """The positions where the intervals of shared signatures of at least ENOUGH hash functions meet.

    The interval of a window are its positions less than ``least`` from c: every position of a passage of that
    length is so near to the least hash of some ``least`` positions of the passage.
    """
    votes = np.zeros(len(shingles), dtype=np.int8)
    for hashes in _hashed(shingles):
        steps = np.zeros(len(shingles) + 1, dtype=np.int64)
        shared = np.isin(hashes, signatures)
        for a, c, b in compact_windows(hashes, least) if shared.any() else []:
            if shared[c]:
                steps[max(a, c - least + 1)] += 1
                steps[min(b, c + least - 1) + 1] -= 1
        votes += np.cumsum(steps[:-1]) > 0
    return votes >= ENOUGH


def _shingle_rows(least: int):
    @lean
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, found = [], []
            for doc_id, text, signatures in zip(batch["doc_id"].to_numpy(), batch["text"], batch["signatures"], strict=True):
                shingles = shingles_of(text)
                if len(shingles) < least:
                    continue
                part = np.unique(shingles[proposed(shingles, np.asarray(signatures).view(np.uint64), least)])
                found.append(part.view(np.int64))
                ids.append(np.full(len(part), doc_id, dtype=np.int64))
            if ids:
                yield pd.DataFrame({"shingle": np.concatenate(found), "doc_id": np.concatenate(ids)})

    return rows


def _firsts(shingles: np.ndarray, known: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which shingles other documents hold, and the first document that holds each of these."""
    order = np.argsort(known)
    known, firsts = known[order], firsts[order]
    at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
    return known[at] == shingles, firsts[at]


def _span_rows(least: int):
    @lean
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = []
            for doc_id, text, known, firsts in zip(*(batch[c] for c in ("doc_id", "text", "shingles", "firsts")), strict=True):
                shingles = shingles_of(text).view(np.int64)
                shared, first = _firsts(shingles, known, firsts)
                owners, which = np.unique(first, return_inverse=True)
                for start, end in similar_stretches(shared, least):
                    own = which[start:end][shared[start:end]]
                    class_id, later = int(owners[np.bincount(own).argmax()]), int((owners[own] < doc_id).sum())
                    spans.append((doc_id, start, end - start + SHINGLE - 1, len(own), later, class_id))
            if spans:
                yield pd.DataFrame(spans, columns=["doc_id", "start_word", "n_words", "n_shared", "n_later", "class_id"])

    return rows


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words from ``start`` to ``end`` of each span, and the white space after them."""
    kept, at = [], 0
    bounds = [(m.start(), m.end()) for m in WORD_AND_SPACE.finditer(text)]
    for start, end in spans:
        kept.append(text[at : bounds[start][0]])
        at = bounds[end - 1][1]
    return "".join([*kept, text[at:]])


def _cut_texts(least: int):
    @lean
    def texts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for columns in batches:
            made = []
            for doc_id, text, known, holders in zip(*columns, strict=True):
                if known is not None and text is not None:
                    own = shingles_of(text).view(np.int64)
                    shared, first = _firsts(own, known, holders)
                    spans = [(a, b + SHINGLE - 1) for a, b in similar_stretches(shared & (first < doc_id), least)]
                    text = _cut(text, spans) if spans else text
                made.append(text)
            yield pd.Series(made, dtype=object)

    return F.pandas_udf(texts, T.StringType())


def _known(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """The documents with a proposed passage, and each one's shingles that others hold, with the first holders."""
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    windows = written(docs.mapInPandas(_signature_rows(least), "signature long, doc_id long"), "windows")
    two = (F.min("doc_id") != F.max("doc_id")).alias("two")
    shared = windows.groupBy("signature").agg(two).where("two").select("signature")
    shared = written(shared, "signatures")
    found = windows.join(shared, "signature", "left_semi").groupBy("doc_id").agg(F.collect_set("signature").alias("signatures"))
    found = written(found.where(F.size("signatures") >= ENOUGH), "proposed")
    forget(windows, shared)
    candidates = written(docs.join(found, "doc_id"), "candidates")
    shingles = written(candidates.mapInPandas(_shingle_rows(least), "shingle long, doc_id long"), "shingles")
    counted = shingles.groupBy("shingle").agg(F.min("doc_id").alias("first"), two).where("two").select("shingle", "first")
    counted = written(counted, "counted")
    held = written(shingles.join(counted, "shingle"), "held")
    forget(found, shingles, counted)  # tables and shuffles of one step go before the next one needs the disk
    known = held.groupBy("doc_id").agg(F.collect_set(F.struct("shingle", "first")).alias("known"))
    known = written(known.select("doc_id", F.col("known.shingle").alias("shingles"), F.col("known.first").alias("firsts")), "known")
    forget(held)
    return candidates, known


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The passages of ``docs(doc_id, text, ...)`` of at least ``least_words`` words that other documents repeat.

    A row for each passage: (doc_id, start_word, n_words, n_shared, n_later, class_id). Words are cut at ASCII
    white space, A-Z in lower case. At least 0.8 of a passage's five-word shingles (n_shared of n_words - 4)
    stand in the proposed passages of other documents too, n_later of them in documents with smaller ids.
    ``class_id`` is the smallest doc_id that holds most of them: equal for all copies of a passage, and the
    document's own id where it comes first. Passages begin and end in shared shingles and are as long as their
    share allows, whatever stands in between; those of a document may overlap, but none lies in another.

    Nothing is paired: a passage in any number of documents costs each of them its own shingles, and counts are
    combined in each task before they are shuffled. Null or short texts have no passages. Rows with a null
    doc_id take no part. Rows that repeat a doc_id are one document and each row's passages are listed.
    Repeats within one document do not count. Further columns are ignored; an empty table gives no rows.
    """
    least = least_words - SHINGLE + 1
    candidates, known = _known(docs, least)
    return candidates.select("doc_id", "text").join(known, "doc_id").mapInPandas(
        _span_rows(least), "doc_id long, start_word int, n_words int, n_shared int, n_later int, class_id long"
    )


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with each repeated passage cut from all documents but the first that holds it.

    A stretch goes if at least 0.8 of its shingles stand in proposed passages of documents with smaller ids.
    Other rows and all other columns stay as they are, also texts that are cut down to nothing.
    """
    least = least_words - SHINGLE + 1
    _, known = _known(docs, least)
    known = known.select(F.col("doc_id").alias("known_id"), "shingles", "firsts")
    rows = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), "doc_id", "text")
    joined = rows.join(known, F.col("doc_id") == F.col("known_id"), "left")
    new = _cut_texts(least)(F.coalesce("known_id", F.lit(0).cast("long")), "text", "shingles", "firsts").alias("new")
    return joined.select("row", new).select(*[(F.col("new") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])

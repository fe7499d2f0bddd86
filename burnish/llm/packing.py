"""Best-fit packing planned on the histogram of lengths.

Best fit by decreasing length depends on the lengths only. So the plan is made over counts: a run of equal
lengths goes into a range of equal sequences at once, which leaves a few thousand ranges however many
documents there are. Each piece has a rank within its length and takes the slot that the plan has for it.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from burnish.llm.common import lean, sized
from burnish.llm.encoding import Encoder
from burnish.sources.shared import written

CAPACITY = 1024
END = 2  # the id after each document


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit over counts: rows (length, first rank, first sequence, pieces a sequence, offset).

    From its first rank on, until the next row of its length, a row puts so many pieces after each other into
    each sequence. Lengths go from long to short, each into the sequence with the least room that holds it.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> ranges (first sequence, how many)
    sequences = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            free = next((r for r in range(length, capacity) if room[r]), capacity)
            if free == capacity:
                first, many = sequences, -(-left // (capacity // length))
                sequences += many
            else:
                first, many = room[free].pop()
            each = min(free // length, left)
            used = min(many, left // each)
            rows.append((length, rank, first, each, capacity - free))
            rank, left = rank + used * each, left - used * each
            room[free - each * length].append((first, used))
            if used < many:
                if free < capacity:
                    room[free].append((first + used, many - used))
                else:  # the last new sequence gets what is left
                    rows.append((length, rank, first + used, left, 0))
                    room[capacity - left * length].append((first + used, 1))
                    left = 0
    return rows


def _piece_rows(capacity: int, end: int, vocabulary: str | None, ranks: str | None, with_ids: bool):
    @lean
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(vocabulary, ranks)
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            found = []
            for at, text in enumerate(batch["text"]):
                ids = np.append(encoder.ids(text or ""), np.uint32(end)).astype("<u4")
                first = len(ids) % capacity or min(len(ids), capacity)
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    data = ids[a:b].tobytes()
                    found.append((at, piece, a, b - a, zlib.crc32(data), part, seen[b - a], *([data] if with_ids else [])))
                    seen[b - a] += 1
            names = ["at", "piece", "start", "length", "ids_crc32", "part", "rank", *(["ids"] if with_ids else [])]
            pieces = pd.DataFrame(found, columns=names)
            pieces.insert(0, "doc_id", batch["doc_id"].iloc[pieces["at"].to_numpy(dtype=np.int64)].to_numpy())
            yield pieces.drop(columns="at")

    return rows


def _slot_rows(rows: list[tuple[int, int, int, int, int]]):
    slots = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    starts = (slots[:, 0] << 44) + slots[:, 1]  # lengths below 2**19, ranks below 2**44

    @lean
    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            slot = slots[np.searchsorted(starts, (length << 44) + rank, side="right") - 1]
            nth = rank - slot[:, 1]
            yield batch.drop(columns="rank").assign(
                sequence_id=slot[:, 2] + nth // slot[:, 3], offset=slot[:, 4] + nth % slot[:, 3] * length
            )

    return placed


def packed(
    docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str | None = None, ranks: str | None = None, with_ids: bool = False
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces of ``docs(doc_id, text, ...)``.

    A document is its ids and then ``end``; null texts are empty. Longer ones than ``capacity`` are cut, and the
    first piece is the shorter one. ``with_ids`` adds the ids as bytes (unsigned 32 bits, little-endian).
    Rows are packed one by one, also if they repeat an id or have none; further columns are ignored.

    The driver sees a count for each length, at most ``capacity`` of them. Each task numbers its own pieces
    within their lengths; the counts of tasks are added up by length, and no piece is sorted or windowed.
    """
    schema = "doc_id string, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids binary" * with_ids
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # pandas has no long beside nulls
    pieces = texts.mapInPandas(_piece_rows(capacity, end, vocabulary, ranks, with_ids), schema)
    pieces = written(pieces, "pieces")
    counts = written(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(sized(written(bases, "bases")), ["part", "length"])
    ranked = ranked.select(*[c for c in pieces.columns if c not in ("part", "rank")], (F.col("base") + F.col("rank")).alias("rank"))
    schema = "doc_id string, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", sequence_id long, offset long"
    placed = ranked.mapInPandas(_slot_rows(plan(histogram, capacity)), schema)
    return placed.withColumn("doc_id", F.col("doc_id").cast("long"))

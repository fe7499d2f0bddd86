"""Delimited files with line breaks in quoted fields, read by many tasks.

Whether a line feed ends a record depends on all quotes before it, so Spark's reader gives such a file to one task.
Here every block of a file first says what it makes of either start, inside or outside of a quoted field. These
answers are put together along the file, after which each block knows how it starts and cuts its own records;
only records that reach over the end of a block are put together from parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from burnish.operators import lookup
from burnish.sources.shared import written

BOM = "﻿"
WHOLE, HEAD, THROUGH, TAIL = range(4)  # a record, or the part of one that a block holds
PIECE_BYTES = 1 << 20  # of lines that become Python objects at a time
RECORDS = "file long, start long, part int, header boolean, record string"
_RECORDS = pa.schema([("file", pa.int64()), ("start", pa.int64()), ("part", pa.int32()), ("header", pa.bool_()), ("record", pa.string())])


def inside_after(line: str, inside: bool, sep: str) -> bool:
    """Whether a quoted field is open after ``line``, which starts inside of one or at the start of a record.

    A quote opens a field at its start only. Inside, two quotes are one character; what follows a single one runs
    to the next delimiter, quotes or not.
    """
    at = 0 if inside else 1 if line.startswith('"') else _opened(line, 0, sep)
    while at >= 0:
        at = line.find('"', at)
        while at >= 0 and line.startswith('"', at + 1):
            at = line.find('"', at + 2)
        if at < 0:
            return True
        at = _opened(line, at + 1, sep)
    return False


def _opened(line: str, start: int, sep: str) -> int:
    """The place after the next quote that opens a field, -1 without one."""
    at = line.find(sep + '"', start)
    return at if at < 0 else at + 2


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, which are cut by rows, in pieces of about PIECE_BYTES, or of one longer line."""
    for batch in batches:
        pieces = np.cumsum(pc.binary_length(batch.column("value")).to_numpy().astype(np.int64) + 1) // PIECE_BYTES
        cuts = (np.flatnonzero(np.diff(pieces)) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(batch)], strict=True):
            yield batch.slice(a, b - a)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int]]:
    """(file, start, first row, end) of the rows of each block in a batch."""
    file, start = batch.column("file").to_numpy(), batch.column("start").to_numpy()
    cuts = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(file)], strict=True):
        if a < b:
            yield int(file[a]), int(start[a]), a, b


def _block_ends(sep: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"file": block[0], "start": block[1], "after_out": ends[0], "after_in": ends[1], "returns": returns}])

        block, ends, returns = None, [False, True], False
        for batch in _pieces(batches):
            lines = batch.column("value")
            quoted = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
            for file, start, a, b in _runs(batch):
                if block != (file, start):
                    if block:
                        yield told()
                    block, ends = (file, start), [False, True]
                    returns = start == 0 and lines[a].as_py().endswith("\r")
                for i in quoted[np.searchsorted(quoted, a) : np.searchsorted(quoted, b)]:
                    line = lines[int(i)].as_py()
                    ends = [inside_after(line, e, sep) for e in ends]
        if block:
            yield told()

    return rows


def block_starts(ends: DataFrame) -> DataFrame:
    """(file, start, inside, returns): how each block starts, from what the blocks before it make of either start.

    A block whose ends agree settles the state; one that swaps them turns it. So the state is that of the last
    settled block, turned as often as blocks since then do. ``returns`` says that the first line of the file ends
    in a carriage return, which then belongs to the ends of all its lines.
    """
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    turns = (F.col("after_out") & ~F.col("after_in")).cast("long")
    counted = ends.withColumns({"turns": turns, "earlier": F.coalesce(F.sum(turns).over(before), F.lit(0))})
    settled = F.when(F.col("after_out") == F.col("after_in"), (F.col("after_out").cast("long") + F.col("earlier")) % 2)
    last = F.coalesce(F.last(settled, ignorenulls=True).over(before), F.lit(0))
    returns = F.max("returns").over(Window.partitionBy("file")).alias("returns")
    return counted.select("file", "start", ((last + F.col("earlier")) % 2 == 1).alias("inside"), returns)


def _cut_records(sep: str, whole: bool):
    """Whole records of each block, or the parts of those that reach over its ends."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []

        def add(block: tuple[int, int], part: int, header: bool, record: str) -> None:
            if (part == WHOLE) == whole:
                found.append((*block, part, header, record))

        def made() -> pa.RecordBatch:
            columns = zip(*found, strict=True) if found else [[]] * len(_RECORDS)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RECORDS, strict=True)], schema=_RECORDS)
            found.clear()
            return batch

        block, inside, headed, open_lines, part = None, False, True, [], WHOLE

        def closed() -> None:
            """The end of a block."""
            if block and (open_lines or part == HEAD):
                add(block, THROUGH if part == HEAD else TAIL, not headed, "\n".join(open_lines))

        for batch in _pieces(batches):
            lines, starts = batch.column("value"), batch.column("inside")
            quoted = pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)
            for file, start, a, b in _runs(batch):
                if block != (file, start):
                    closed()
                    block, inside, headed = (file, start), starts[a].as_py(), start > 0
                    open_lines, part = [], HEAD if inside else WHOLE
                if whole and headed and not inside and not quoted[a:b].any():  # every line is a record
                    yield made()
                    part_of = lines.slice(a, b - a)
                    own = part_of.filter(pc.not_equal(part_of, ""))
                    n = len(own)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, x), f.type) for x, f in zip((file, start, WHOLE, False), _RECORDS, strict=False)] + [own], schema=_RECORDS
                    )
                    continue
                for i, line in enumerate(lines.slice(a, b - a).to_pylist(), a):
                    if start == 0 and not headed and not inside:
                        line = line.removeprefix(BOM)
                    inside = inside_after(line, inside, sep) if quoted[i] else inside
                    open_lines.append(line)
                    if inside:
                        continue
                    record = "\n".join(open_lines)
                    if part == HEAD or record:
                        add(block, part, not headed and part == WHOLE, record)
                        headed = True
                    open_lines, part = [], WHOLE
            if found:
                yield made()
        closed()
        yield made()

    return rows


def _sized(stored: DataFrame) -> DataFrame:
    size = stored.agg(F.sum(lookup.row_bytes(stored))).first()[0] or 0
    return F.broadcast(stored) if size <= lookup.BROADCAST_BYTES else stored.hint("merge")


def _lines(spark: SparkSession, paths: str | list[str], encoding: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(paths)
    utf8 = encoding.upper().replace("-", "") == "UTF8"
    value = F.make_valid_utf8("value") if utf8 else F.decode(F.col("value").cast("binary"), encoding)
    block = [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    return lines.select(*block, value.alias("value"))


def records(spark: SparkSession, paths: str | list[str], sep: str, encoding: str) -> DataFrame:
    """(file, header, record): the records of delimited files, with line breaks inside of quoted fields.

    Lines end in a line feed, or in a carriage return and one if the first line does; these become a line feed in
    fields too, as in Spark's reader. Empty lines between records are left out. ``file`` is a hash of the path and ``header`` marks the first record of a file. Each block of Spark's text reader is cut
    by its own task, so the tasks are as many as blocks. A record must fit into a task; a quoted field that is
    never closed makes the rest of its file one record, as in any reader.

    Runs one job over all lines, which returns two flags for each block, and a second one where a record reaches
    over the end of a block. The result reads the lines once more when it is used.
    """
    lines = _lines(spark, paths, encoding)
    ends = written(lines.mapInArrow(_block_ends(sep), "file long, start long, after_out boolean, after_in boolean, returns boolean"), "block-ends")
    starts = written(block_starts(ends), "block-starts")
    line = F.when(F.col("returns") & F.col("value").endswith("\r"), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    told = lines.join(_sized(starts), ["file", "start"]).select("file", "start", line.alias("value"), "inside")
    cut = told.mapInArrow(_cut_records(sep, True), RECORDS).select("file", "header", "record")
    broken = starts.where("inside").limit(1).count() or ends.groupBy("file").agg(F.max_by("after_out", "start").alias("o")).where("o").limit(1).count()
    if broken:
        cut = cut.unionByName(_joined_parts(told, sep))
    return cut


def _joined_parts(told: DataFrame, sep: str) -> DataFrame:
    """The records that reach over the ends of blocks: a tail, whole blocks, and the head of a later one."""
    parts = written(told.mapInArrow(_cut_records(sep, False), RECORDS), "parts")
    so_far = Window.partitionBy("file").orderBy("start", "part")
    chain = F.sum((F.col("part") == TAIL).cast("int")).over(so_far).alias("chain")
    pieces = F.array_sort(F.collect_list(F.struct("start", "part", "record"))).alias("pieces")
    joined = parts.select("*", chain).groupBy("file", "chain").agg(pieces, F.bool_or("header").alias("header"))
    return joined.select("file", "header", F.array_join("pieces.record", "\n").alias("record"))


def larger_than_a_split(spark: SparkSession, paths: str | list[str]) -> bool:
    """Whether any file is too large for one split. Only the listing is read."""
    most = F.max("length").alias("most")
    found = spark.read.format("binaryFile").load(paths).select("length").agg(most).first().most or 0
    return found > _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))


def _bytes(size: str) -> int:
    """The bytes of a size as it is set: a number, or one with a unit (b, k, m, g, t)."""
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    plain = size.strip().lower().removesuffix("b")
    return int(plain[:-1]) * units[plain[-1]] if plain[-1:] in units else int(plain)

"""WARC archives as bundles of independent Zstandard frames with a seek table.

Records are grouped into frames of about FRAME_BYTES and frames into bundles of about BUNDLE_BYTES. A bundle
ends in a skippable frame with the compressed and plain size of every frame, in the seekable format of the
Zstandard project, so one frame can be read alone. The index maps a record to its frame and its place there.

Spark itself writes and reads the bundles, in any store that it reaches: the text writer puts one row into a
file and ends it with a line separator, and the seek table's last four bytes serve as the separator.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.sources.shared import new_path, written

FRAME_BYTES = 64 * 1024
BUNDLE_BYTES = 8 * 1024 * 1024
LEAST_REVISIT = 100  # bytes; smaller payloads are always stored
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"  # pages carry no date
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
UNFIT = re.compile(r"[\x00-\x20\x7f]")


def _name(page_id: str | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, first: str | None) -> bytes:
    """A response record, or a revisit of the page ``first``, which has the header of the reply but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if first is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + UNFIT.sub(lambda m: f"%{ord(m.group()):02X}", url))
    if first is not None:
        head += [f"WARC-Refers-To: {_name(first)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Bundle:
    """Collects records; ``data`` is the bundle without the four bytes that end it."""

    def __init__(self) -> None:
        self._encoder = zstandard.ZstdCompressor(level=LEVEL)
        self._frames: list[bytes] = []
        self._sizes: list[tuple[int, int]] = []
        self._open: list[bytes] = []
        self.size = self._waiting = self.records = 0

    def add(self, data: bytes) -> None:
        self._open.append(data)
        self._waiting += len(data)
        self.records += 1
        if self._waiting >= FRAME_BYTES:
            self._close_frame()

    def _close_frame(self) -> None:
        if self._open:
            frame = self._encoder.compress(b"".join(self._open))
            self._frames.append(frame)
            self._sizes.append((len(frame), self._waiting))
            self.size += len(frame)
            self._open, self._waiting = [], 0

    def data(self) -> bytes:
        self._close_frame()
        table = b"".join(struct.pack("<II", *s) for s in self._sizes) + struct.pack("<IB", len(self._sizes), 0)
        return b"".join(self._frames) + struct.pack("<II", SKIPPABLE, len(table) + 4) + table


def _bundles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, nth, bundle = TaskContext.get().partitionId(), 0, _Bundle()
    for batch in batches:
        for page_id, url, payload, digest, first, revisit in zip(
            *(batch[c] for c in ("page_id", "url", "payload", "digest", "first", "revisit")), strict=True
        ):
            bundle.add(record(page_id, url, payload, digest, first if revisit else None))
            if bundle.size >= BUNDLE_BYTES:
                yield pd.DataFrame({"part": [part], "nth": [nth], "data": [bundle.data()]})
                nth, bundle = nth + 1, _Bundle()
    if bundle.records:
        yield pd.DataFrame({"part": [part], "nth": [nth], "data": [bundle.data()]})


def write_bundles(pages: DataFrame, path: str) -> None:
    """A record for each row of ``pages(page_id, url, html, ...)``, as bundles in the new folder ``path``.

    The payload is the html in UTF-8, empty if null. Of pages with equal payloads of at least LEAST_REVISIT
    bytes the one with the smallest page_id is stored and the others revisit it; rows that repeat that id, and
    rows of payloads whose pages all lack an id, are stored each. Groups of copies are found from digests alone.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    copies = rows.where(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest")
    copies = copies.agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    copies = written(copies.select(F.col("digest").alias("copied"), "first"), "copies")
    revisit = F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull())
    rows = rows.join(copies, F.col("digest") == F.col("copied"), "left").withColumn("revisit", revisit).drop("copied")
    texts = {c: F.col(c).cast("string") for c in ("page_id", "first")}  # pandas has no long beside nulls
    bundles = written(rows.withColumns(texts).mapInPandas(_bundles, "part int, nth int, data binary"), "bundles")
    end = struct.pack("<I", SEEKABLE).decode("latin-1")
    lines = bundles.select(F.col("data").cast("string").alias("value"))
    lines.write.options(lineSep=end, encoding="ISO-8859-1", maxRecordsPerFile=1).text(path)


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of each frame of a bundle."""
    many, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    start, frames = 0, []
    for packed, plain in struct.iter_unpack("<II", data[len(data) - 9 - 8 * many : len(data) - 9]):
        frames.append((start, packed, plain))
        start += packed
    if struct.unpack_from("<II", data, start) != (SKIPPABLE, 8 * many + 9):
        raise ValueError("the seek table does not fit the frames")
    return frames


def frame(data: bytes, at: tuple[int, int, int]) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data[at[0] : at[0] + at[1]], max_output_size=at[2])


def parsed(plain: bytes, offset: int) -> tuple[dict[str, str], bytes, int]:
    """The header fields and the block of the record at ``offset`` of a frame, and where the next one starts."""
    body = plain.index(b"\r\n\r\n", offset) + 4
    version, *lines = plain[offset : body - 4].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"no record at {offset}")
    fields = dict(line.split(": ", 1) for line in lines)
    end = body + int(fields["Content-Length"])
    return fields, plain[body:end], end + 4


def _page(name: str) -> int | None:
    number = name.removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "bundle", "frame", "frame_offset", "record_bytes"]
    for batch in batches:
        for path, data in zip(batch["path"], batch["content"], strict=True):
            found = []
            for nth, at in enumerate(seek_table(data)):
                plain, offset = frame(data, at), 0
                while offset < len(plain):
                    fields, block, after = parsed(plain, offset)
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"Content-Length: (\d+)", head).group(1))
                    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
                    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{fields['WARC-Record-ID']} in {path} is damaged")
                    refers_to = _page(fields["WARC-Refers-To"]) if kind == "revisit" else None
                    found.append((_page(fields["WARC-Record-ID"]), size, digest, kind, refers_to, path, nth, offset, after - offset))
                    offset = after
            table = dict(zip(columns, map(list, zip(*found, strict=True)), strict=True))
            yield pd.DataFrame(table | {c: pd.array(table[c], dtype="Int64") for c in ("page_id", "refers_to")})


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """What the bundles under ``path`` hold: a row for each record, with its bundle, frame and place in the frame.

    All frames are opened and all stored payloads are held against their digests; a damaged one is an error.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(
        _entries,
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "bundle string, frame int, frame_offset long, record_bytes long",
    )


def archived(pages: DataFrame) -> DataFrame:
    """``read_index`` of bundles written for ``pages``; without rows there are no bundles and no entries."""
    path = new_path(pages.sparkSession, "warc")
    write_bundles(pages, path)
    return read_index(pages.sparkSession, path)

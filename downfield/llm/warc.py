"""Seekable WARC bundles (operator 1).

A bundle is a file of Zstandard frames with a seek table as its footer. Each frame holds whole WARC records and can
be read alone; the index maps a record to its bundle, its frame and its place in the decompressed frame. Bundles
are written to and read from the shared folder through Arrow's file systems, one task per bundle at a time.
A task that runs again writes new files; the index names only the files of the attempts that were committed.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, stored, utf8

# Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

MOST_TASKS = 20_000  # that read bundles; beyond it a task reads several

INDEX = (
    "page_id long, record_type string, bundle string, frame int, frame_offset long, frame_bytes long, "
    "record_offset long, record_bytes long"
)
RECORDS = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, "
    "payload binary"
)


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer for frames of (compressed, decompressed) bytes."""
    entries = b"".join(struct.pack("<II", *f) for f in frames)
    footer = struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """(offset, compressed bytes, decompressed bytes) of every frame of an open bundle."""
    size = file.size()
    file.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("the file has no seek table")
    width = 12 if flags & 0x80 else 8
    file.seek(size - 9 - count * width)
    table, out, at = file.read(count * width), [], 0
    for i in range(count):
        packed, plain = struct.unpack_from("<II", table, i * width)
        out.append((at, packed, plain))
        at += packed
    return out


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    text = name.strip("<>").rpartition(":")[2]
    return None if text == "null" else int(text)


def record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, revisit: bool, refers_to: int | None, date: str
) -> bytes:
    """One WARC record. A revisit keeps the HTTP header, with the payload's length, and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        # all but printable ASCII is escaped, so an address cannot end the line
        address = quote(url, safe="".join(chr(c) for c in range(33, 127) if chr(c) != "%"))
        head.append(f"WARC-Target-URI: {address}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {_name(refers_to)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that starts at a place of a decompressed frame, and the place after it."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    head = dict(line.split(": ", 1) for line in lines[1:])
    start = end + 4
    stop = start + int(head["Content-Length"])
    body = data.index(b"\r\n\r\n", start, stop) + 4
    http = dict(x.split(": ", 1) for x in data[start : body - 4].decode().split("\r\n")[1:])
    revisit = head["WARC-Type"] == "revisit"
    payload = None if revisit else data[body:stop]
    stated = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if payload is not None and hashlib.sha1(payload).hexdigest() != stated:
        raise ValueError(f"payload of {head['WARC-Record-ID']} does not fit its digest")
    return {
        "page_id": _page(head["WARC-Record-ID"]),
        "url": unquote(head["WARC-Target-URI"]) if "WARC-Target-URI" in head else None,
        "record_type": head["WARC-Type"], "payload_digest": stated, "payload": payload,
        "payload_bytes": int(http["Content-Length"]) if revisit else len(payload),
        "refers_to": _page(head["WARC-Refers-To"]) if revisit else None,
    }, stop + 4


class BundleWriter:
    """Writes records to bundles below a folder; `places` has an index row for every record of closed frames."""

    def __init__(self, folder: str, frame_bytes: int, bundle_bytes: int):
        import zstandard

        self.folder, self.frame_bytes, self.bundle_bytes = folder, frame_bytes, bundle_bytes
        self.store, self.path = fs.FileSystem.from_uri(folder)
        self.store.create_dir(self.path, recursive=True)
        self.packer = zstandard.ZstdCompressor(level=3)
        self.file, self.places = None, []

    def add(self, page_id: int | None, kind: str, data: bytes) -> None:
        if self.file is None:
            self.bundle = f"bundle-{uuid.uuid4().hex}.warc.zst"
            self.file = self.store.open_output_stream(f"{self.path}/{self.bundle}", compression=None)
            self.frames, self.offset, self.parts, self.held, self.waiting = [], 0, [], 0, []
        self.waiting.append((page_id, kind, self.held, len(data)))
        self.parts.append(data)
        self.held += len(data)
        if self.held >= self.frame_bytes:
            self._end_frame()
            if self.offset >= self.bundle_bytes:
                self.close()

    def _end_frame(self) -> None:
        packed = self.packer.compress(b"".join(self.parts))
        self.file.write(packed)
        for page_id, kind, at, size in self.waiting:
            self.places.append(
                (page_id, kind, f"{self.folder}/{self.bundle}", len(self.frames), self.offset, len(packed), at, size)
            )
        self.frames.append((len(packed), self.held))
        self.offset += len(packed)
        self.parts, self.held, self.waiting = [], 0, []

    def close(self) -> None:
        if self.file is not None:
            if self.waiting:
                self._end_frame()
            self.file.write(seek_table(self.frames))
            self.file.close()
            self.file = None

    def taken(self) -> list[tuple]:
        rows, self.places = self.places, []
        return rows


def deduplicated(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """(page_id, url, payload, payload_digest, revisit, refers_to) of every page.

    Of pages with equal payloads of at least `least_bytes`, that with the largest page_id is the response and the
    others revisit it. Repeated rows of that page are responses too; if none of the pages has an id, all are.
    """
    rows = pages.select("page_id", "url", utf8("html").alias("payload")).withColumn("payload_digest", F.sha1("payload"))
    known = pages.select("page_id", utf8("html").alias("payload")).where(F.octet_length("payload") >= least_bytes)
    last = known.groupBy(F.sha1("payload").alias("payload_digest")).agg(
        F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")
    ).where("n > 1").drop("n")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return rows.join(last, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_digest", revisit.alias("revisit"),
        F.when(revisit, F.col("last")).alias("refers_to"),
    )


def write_bundles(
    pages: DataFrame, folder: str, least_bytes: int = 1000, frame_bytes: int = 1 << 20, bundle_bytes: int = 256 << 20,
    date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Writes a WARC record per page below `folder` and returns the stored index of all records.

    A null html is an empty payload; a null url gives a record without address.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        names = [f.split()[0] for f in INDEX.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

        def rows() -> pa.RecordBatch:
            found = list(zip(*writer.taken())) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, kinds)], names)

        for batch in batches:
            writer = writer or BundleWriter(folder, frame_bytes, bundle_bytes)
            for i in range(batch.num_rows):
                page_id, url, payload, digest, revisit, refers_to = (c[i].as_py() for c in batch.columns)
                data = record(page_id, url, payload, digest, revisit, refers_to, date)
                writer.add(page_id, "revisit" if revisit else "response", data)
            yield rows()
        if writer is not None:
            writer.close()
            yield rows()

    return stored(deduplicated(pages, least_bytes).mapInArrow(run, INDEX), "warc-index")


def _records(rows: list[dict], with_payload: bool) -> pa.RecordBatch:
    if not with_payload:
        rows = [r | {"payload": None} for r in rows]
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
    ])
    return pa.RecordBatch.from_pylist(rows, schema)


def read_bundles(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of the bundles that an index names, read frame by frame.

    Digest and length are those of the payload read for a response, and those stated for a revisit. A payload
    that does not fit its digest fails the read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for bundle in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(bundle)
                with store.open_input_file(path) as file:
                    for offset, packed, plain in read_seek_table(file):
                        file.seek(offset)
                        data, at, rows = unpack.decompress(file.read(packed), plain), 0, []
                        while at < len(data):
                            found, at = parse(data, at)
                            rows.append(found)
                        yield _records(rows, with_payload)

    # names are tiny, so Spark would put all of them into one task; a given number of tasks stays
    names = index.select("bundle").distinct()
    tasks = min(names.count(), MOST_TASKS)
    return names.repartition(max(tasks, 1)).mapInArrow(run, RECORDS)


def fetch(index: DataFrame, pages: DataFrame) -> DataFrame:
    """The records of the pages (page_id) given, each read from its frame alone.

    The frame is decompressed up to the end of the record. An id without a record gives no row; a null id matches none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for row in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(row["bundle"])
                with store.open_input_file(path) as file:
                    file.seek(row["frame_offset"])
                    packed = file.read(row["frame_bytes"])
                reader = zstandard.ZstdDecompressor().stream_reader(packed)
                reader.read(row["record_offset"])
                yield _records([parse(reader.read(row["record_bytes"]))[0]], True)

    wanted = index.join(pages.select("page_id").distinct(), "page_id")
    places = wanted.select("bundle", "frame_offset", "frame_bytes", "record_offset", "record_bytes")
    return places.mapInArrow(run, RECORDS)


def round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, as read back from new bundles.

    A null page is an empty payload; empty and short ones are responses. Of equal payloads of `least_bytes` or more the
    one with the largest id is the response, and where no id is known any of them. Repeated rows are records of their
    own, null ids stay null, very long pages are one record each, and columns besides page_id, url and html take no
    part. An empty table gives no rows.
    """
    index = write_bundles(pages, shared_path(spark, "warc"), least_bytes)
    return read_bundles(index, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )

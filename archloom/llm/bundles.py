"""Seekable Zstandard bundles of WARC records.

A bundle is a file of independent Zstandard frames, each holding whole records, then two skippable
frames: the record index (record identifier -> frame, offset in the frame, length) and the seek table of
the Zstandard seekable format (compressed and decompressed size of each frame), so that a reader finds
every frame from the end of the file and decompresses only those it needs. Plain Zstandard tools read
the file as one stream of records.

Payloads never meet in one task: equal ones are found by their SHA-1. A task writes its own files,
under a name no other attempt uses, and returns an index of them; only files in that index count,
so lost or repeated attempts leave nothing that is read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import numbered, staged

SEEK_MAGIC, SKIPPABLE, INDEX_SKIPPABLE = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50
INDEX = "file string, record_id string, frame int, frame_offset long, frame_size long, offset long, length long"
RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, file string, frame int, offset long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """The bytes of a response, or of a revisit, which holds the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest32(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    """Writes one bundle. frame_bytes: a frame ends with the record that reaches it."""

    def __init__(self, fs: pafs.FileSystem, path: str, frame_bytes: int, level: int):
        self.out, self.frame_bytes = fs.open_output_stream(path, compression=None), frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.part: list[bytes] = []
        self.names: list[tuple[str, int, int]] = []
        self.size = self.at = 0
        self.sizes: list[tuple[int, int]] = []
        self.index: list[tuple[str, int, int, int, int, int]] = []

    def add(self, name: str, data: bytes) -> None:
        self.names.append((name, self.size, len(data)))
        self.part.append(data)
        self.size += len(data)
        if self.size >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if not self.part:
            return
        frame = self.zstd.compress(b"".join(self.part))
        self.out.write(frame)
        self.index += [(name, len(self.sizes), self.at, len(frame), o, n) for name, o, n in self.names]
        self.sizes.append((len(frame), self.size))
        self.at += len(frame)
        self.part, self.names, self.size = [], [], 0

    def close(self) -> None:
        self.flush()
        index = zstandard.compress(json.dumps([[n, f, o, k] for n, f, _, _, o, k in self.index]).encode())
        self.out.write(struct.pack("<II", INDEX_SKIPPABLE, len(index)) + index)
        self.sizes.append((8 + len(index), 0))  # the table accounts for every byte before it
        table = b"".join(struct.pack("<II", *x) for x in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer)
        self.out.close()


def seek_table(fs: pafs.FileSystem, path: str) -> list[tuple[int, int, int, int]]:
    """(frame, offset, compressed size, decompressed size) of the bundle's frames that hold records."""
    with fs.open_input_file(path) as f:
        end = f.size()
        if end < 17:
            raise ValueError(f"{path}: no seek table")
        f.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEK_MAGIC:
            raise ValueError(f"{path}: no seek table")
        width = 12 if flags & 0x80 else 8
        f.seek(end - 9 - n * width)
        raw = f.read(n * width)
    out, at = [], 0
    for i in range(n):
        c, d = struct.unpack_from("<II", raw, i * width)
        if d:
            out.append((i, at, c, d))
        at += c
    return out


def read_frame(fs: pafs.FileSystem, path: str, offset: int, size: int) -> bytes:
    with fs.open_input_file(path) as f:
        f.seek(offset)
        return zstandard.ZstdDecompressor().decompress(f.read(size))


def record_at(uri: str, frame_offset: int, frame_size: int, offset: int, length: int) -> bytes:
    """One record, by an index row: reads and decompresses its frame alone."""
    fs, path = pafs.FileSystem.from_uri(uri)
    return read_frame(fs, path, frame_offset, frame_size)[offset : offset + length]


def parse(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, WARC headers with lower-case names, block) of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *rest = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}
        n = int(head["content-length"])
        yield at, head, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def with_revisits(pages: DataFrame, page_id: str = "page_id", html: str = "html", least_bytes: int = 0, made: str = "refers") -> DataFrame:
    """The columns of pages and ``made`` (one of that name gives way): the largest page_id of the rows with an equal payload, if that is another and the payload has at least so many bytes.

    Null and empty payloads are equal. Only the SHA-1 values are grouped; groups of one never enter the join, in which a hot payload is split by the planner. An empty table gives an empty result.
    """
    kept = [c for c in pages.columns if c != made]
    rows, names = numbered(pages.select(*[pages[c] for c in kept]))
    payload, i = F.coalesce(F.col(names[html]), F.lit("")), names[page_id]
    keyed = rows.withColumn("sha", F.when(F.octet_length(payload) >= least_bytes, F.sha1(payload.cast("binary"))))
    best = keyed.where("sha IS NOT NULL").groupBy("sha").agg(F.max(i).alias("best"), F.count("*").alias("n")).where("n > 1").select("sha", "best")
    joined = keyed.join(best, "sha", "left")
    return joined.select(*names.values(), F.when(~F.col(i).eqNullSafe(F.col("best")), F.col("best")).alias("refers")).toDF(*kept, made)


def write_bundles(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, frame_bytes: int = 1 << 20, bundle_bytes: int = 1 << 30, level: int = 3, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row under folder (a URI all executors reach) and returns the index, one row a record.

    A null html is an empty payload, a null url leaves the target out, a null page_id makes the identifier urn:page:null. Rows that repeat a page_id make a
    record each; of equal payloads all rows with the largest page_id are responses. The index is lazy: each evaluation writes anew, so stage it.
    """
    marked = with_revisits(pages.select(pages[page_id].alias("i"), pages[url].alias("u"), pages[html].alias("h")), "i", "h", least_bytes, "r")
    fields = [x.split()[0] for x in INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        writer, name, written = None, "", 0

        def close() -> pa.RecordBatch:
            writer.close()
            rows = [(f"{folder}/{name}", *x) for x in writer.index]
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], fields)

        for b in batches:
            for i, u, h, r in zip(*(c.to_pylist() for c in b.columns)):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    writer, written = BundleWriter(fs, f"{root}/{name}", frame_bytes, level), 0
                ident = f"urn:page:{'null' if i is None else i}"
                data = record(ident, u, (h or "").encode(), None if r is None else f"urn:page:{r}", date)
                writer.add(ident, data)
                written += len(data)
                if written >= bundle_bytes:
                    yield close()
                    writer = None
        if writer is not None:
            yield close()

    return marked.mapInArrow(run, INDEX)


def read_bundles(files: DataFrame, payloads: bool = True) -> DataFrame:
    """files (file string, distinct) -> one row a record. payload_bytes and payload_digest are computed from a response's payload, and taken from the
    headers of a revisit, which has none. A payload that doesn't fit its digest raises."""

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                fs, path = pafs.FileSystem.from_uri(uri)
                table = seek_table(fs, path)
                if table:
                    f, o, c, _ = zip(*table)
                    yield pa.RecordBatch.from_arrays([pa.array([uri] * len(table)), pa.array(f, pa.int32()), pa.array(o, pa.int64()), pa.array(c, pa.int64())], ["file", "frame", "at", "size"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.string(), pa.int32(), pa.int64()]
        for b in batches:
            for uri, frame, at, size in zip(*(c.to_pylist() for c in b.columns)):
                fs, path = pafs.FileSystem.from_uri(uri)
                rows = []
                for offset, head, block in parse(read_frame(fs, path, at, size)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    sha = head["warc-payload-digest"].removeprefix("sha1:")
                    n = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
                    if head["warc-type"] == "response" and (digest32(payload) != sha or len(payload) != n):
                        raise ValueError(f"{uri}: the payload of {head['warc-record-id']} doesn't fit its digest")
                    rows.append((head["warc-record-id"].strip("<>"), head["warc-type"], head.get("warc-target-uri"), head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None, sha, n, payload if payloads and head["warc-type"] == "response" else None, uri, frame, offset))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return files.mapInArrow(frames, "file string, frame int, at long, size long").repartition(F.col("file"), F.col("frame")).mapInArrow(records, RECORD)


def round_trip(spark: SparkSession, pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes pages as bundles, reads them back, and returns page_id, payload_bytes, payload_digest, record_type and refers_to per record.

    A null html is an empty payload; a page_id that is null, or no whole number, comes back as null; rows that repeat a page_id make a record each; an empty table gives an empty result.
    """
    index = staged(write_bundles(pages, folder, least_bytes=least_bytes), "bundle-index")
    back = read_bundles(index.select("file").distinct(), payloads=False)
    number = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) AS BIGINT)")
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))

"""WARC and ARC records: a parser for files, plain or of gzip members, and a Spark data source.

A file is one partition and is read as a stream; records are numbered in it. The source's options: ``paths`` (JSON list of files and folders),
``payload`` (false leaves bodies out), ``digest`` (true adds that of each record's bytes in the file), ``types`` (comma-separated record types to keep), ``max_record_bytes``.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from archloom.functions.postquery import url_key

SUFFIXES = (".arc", ".arc.gz", ".warc", ".warc.gz")
SCHEMA = (
    "file_path string, file_rank int, rec_idx int, offset long, length long, rec_type string, rec_headers array<struct<name:string,value:string>>, http_status_line string, "
    "http_headers array<struct<name:string,value:string>>, method string, urlkey string, request_body string, payload binary, payload_length long, digest string, parse_error string"
)


@dataclass
class Record:
    rec_type: str | None = None
    headers: list[tuple[str, str]] = field(default_factory=list)
    status_line: str | None = None
    http: list[tuple[str, str]] | None = None
    payload: bytes = b""
    offset: int = 0
    length: int = 0
    method: str | None = None
    urlkey: str | None = None
    request_body: str | None = None
    error: str | None = None

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.headers if k.lower() == name), None)

    def http_get(self, name: str) -> str | None:
        return next((v for k, v in self.http or () if k.lower() == name), None)


def _located(path: str):
    """(file system, path on it) of a URI; (None, path) of a plain path, which is a local one. Hadoop, object stores and file: are those that pyarrow knows."""
    if not re.match(r"[a-z][a-z0-9+.-]*:/", path):
        return None, path
    import pyarrow.fs as pafs

    if path.startswith("file:"):
        return None, "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def opened(path: str):
    """A readable, seekable binary file."""
    fs, at = _located(path)
    return open(at, "rb") if fs is None else fs.open_input_file(at)


def files_of(paths: list[str]) -> list[str]:
    """Folders are walked for names of archives (case matters); anything else is taken as it is. Paths may be URIs."""
    out = []
    for p in paths:
        fs, at = _located(p)
        if fs is None:
            if os.path.isdir(at):
                out += [os.path.join(d, f) for d, _, names in os.walk(at) for f in names if f.endswith(SUFFIXES)]
            else:
                out.append(p)
            continue
        import pyarrow.fs as pafs

        if fs.get_file_info(at).type == pafs.FileType.Directory:
            root = p[: len(p) - len(at)] if p.endswith(at) else p.split("://")[0] + "://"
            out += [root + f.path for f in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if f.path.endswith(SUFFIXES)]
        else:
            out.append(p)
    return out


def ordered(files: list[str]) -> list[str]:
    """By base name, then by path: the order in which first and last captures are told."""
    return sorted(files, key=lambda f: (os.path.basename(f), f))


def _headers(block: bytes) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in block.decode("utf-8", "replace").split("\n"):
        line = line.rstrip("\r")
        if line[:1] in (" ", "\t") and out:
            out[-1] = out[-1][0], out[-1][1] + " " + line.strip()
        elif ":" in line:
            k, _, v = line.partition(":")
            out.append((k.strip(), v.strip()))
    return out


def _dechunk(data: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = data.find(b"\n", at)
        m = re.match(rb"\s*([0-9a-fA-F]+)", data[at:end]) if end >= 0 else None
        if not m:
            return data if not out else b"".join(out)  # wasn't chunked, or breaks off
        n = int(m[1], 16)
        if n == 0:
            return b"".join(out)
        out.append(data[end + 1 : end + 1 + n])
        at = end + 1 + n
        at += 2 if data[at : at + 2] == b"\r\n" else 1 if data[at : at + 1] == b"\n" else 0


def _decoded(r: Record) -> None:
    """Takes transfer and content codings off the payload; what can't be undone stays, with an error."""
    if (r.http_get("transfer-encoding") or "").lower() == "chunked":
        r.payload = _dechunk(r.payload)
    coding = (r.http_get("content-encoding") or "").lower().strip()
    try:
        if coding in ("gzip", "x-gzip") and r.payload:
            d = zlib.decompressobj(31)
            r.payload = d.decompress(r.payload) + d.flush() if r.payload[:2] == b"\x1f\x8b" else r.payload
        elif coding == "deflate" and r.payload:
            try:
                r.payload = zlib.decompress(r.payload)
            except zlib.error:
                r.payload = zlib.decompress(r.payload, -15)
        elif coding and coding not in ("identity", "utf-8"):
            r.error = f"content coding {coding} isn't supported"
    except zlib.error as e:
        r.error = f"content coding {coding}: {e}"


def _split_http(r: Record, block: bytes) -> None:
    m = re.search(rb"\r?\n\r?\n", block)
    head, r.payload = (block[: m.start()], block[m.end() :]) if m else (block, b"")
    first, _, rest = head.partition(b"\n")
    r.status_line = first.decode("utf-8", "replace").strip()
    r.http = _headers(rest)


class _Counting(io.RawIOBase):
    """Bytes read so far of a file, for offsets."""

    def __init__(self, f):
        self.f, self.at, self.back = f, 0, b""

    def take(self, n: int) -> bytes:
        out = self.back[:n]
        self.back = self.back[n:]
        if len(out) < n:
            out += self.f.read(n - len(out))
        self.at += len(out)
        return out

    def untake(self, data: bytes) -> None:
        self.back = data + self.back
        self.at -= len(data)


def _members(f: _Counting) -> Iterator[tuple[int, int, bytes, str | None]]:
    """(offset, length, content, error) of each gzip member."""
    while True:
        begin, data = f.at, f.take(1 << 16)
        if not data:
            return
        d, parts, error = zlib.decompressobj(31), [], None
        try:
            while True:
                parts.append(d.decompress(data))
                if d.eof:
                    f.untake(d.unused_data)
                    break
                data = f.take(1 << 16)
                if not data:
                    error = "the gzip member is cut off"
                    break
        except zlib.error as e:
            error = f"broken gzip member: {e}"
        yield begin, f.at - begin, b"".join(parts), error
        if error:
            return


def _parse(read, offset: int, most: int) -> Record | None:
    """The next record of a stream that read(line: bool, n) gives; None at its end."""
    line = b"\n"
    while line in (b"\n", b"\r\n"):
        line = read(True, 0)
    if not line:
        return None
    r = Record(offset=offset)
    text = line.decode("utf-8", "replace").rstrip("\r\n")
    if text.startswith("WARC/"):
        head = []
        while (line := read(True, 0)) not in (b"\r\n", b"\n", b""):
            head.append(line)
        r.headers = _headers(b"".join(head))
        r.rec_type = r.get("warc-type")
        n = r.get("content-length") or "0"
    else:  # ARC: url ip date mime length
        parts = text.split(" ")
        if len(parts) < 5:
            r.error = f"no record: {text[:80]!r}"
            return r
        url, _, date, mime, n = parts[0], parts[1], parts[2], parts[-2], parts[-1]
        r.rec_type = "warcinfo" if url.startswith("filedesc:") else "response"
        iso = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z" if len(date) == 14 else date
        r.headers = [("WARC-Target-URI", url), ("WARC-Date", iso), ("Content-Type", mime), ("Content-Length", n)]
    try:
        size = int(n)
    except ValueError:
        r.error = f"content length {n!r}"
        return r
    block = read(False, size)
    if len(block) < size:
        r.error = "the record is cut off"
    if size > most:
        r.error, block = f"record of {size} bytes", b""
    kind = (r.get("content-type") or "").lower()
    is_http = r.rec_type in ("response", "request", "revisit") and (kind.startswith("application/http") or not text.startswith("WARC/")) and block and (r.get("warc-target-uri") or "http").startswith("http")
    if is_http:
        _split_http(r, block)
        _decoded(r)
    else:
        r.payload = block
    return r


def records(path: str, most: int = 1 << 31) -> Iterator[Record]:
    """The records of a file. A broken one carries an error and, where the rest can't be found, ends the file."""
    with opened(path) as raw:
        f = _Counting(raw)
        magic = f.take(2)
        f.untake(magic)
        if magic == b"\x1f\x8b":
            for offset, length, content, error in _members(f):
                b = io.BytesIO(content)
                while r := _parse(lambda line, n, b=b: b.readline() if line else b.read(n), offset, most):
                    r.length = length
                    r.error = r.error or error
                    yield r
                if error and not content:
                    yield Record(offset=offset, length=length, error=error)
            return
        b = io.BufferedReader(raw)
        raw.seek(0)
        while True:
            begin = b.tell()
            r = _parse(lambda line, n: b.readline() if line else b.read(n), begin, most)
            if r is None:
                return
            r.length = b.tell() - begin
            yield r
            if r.error and not r.rec_type:
                return


def _pair(a: Record, b: Record) -> bool:
    return a.get("warc-target-uri") == b.get("warc-target-uri") and b.get("warc-concurrent-to") == a.get("warc-record-id") and {a.rec_type, b.rec_type} == {"request", "response"}


def _join(request: Record, response: Record) -> None:
    if request.http is None:
        return
    method, _, _ = (request.status_line or "").partition(" ")
    if method not in ("POST", "PUT"):
        return
    url = request.get("warc-target-uri") or ""
    query, key = url_key(method, request.http_get("content-type"), request.http_get("content-length"), request.payload, url)
    response.method, response.request_body = method, query
    response.urlkey = request.urlkey = key


def paired(source: Iterator[Record]) -> Iterator[Record]:
    """Joins each request with the response next to it, in either order. A record is in one pair at most."""
    held: Record | None = None
    for r in source:
        if held is not None and _pair(held, r):
            _join(*((held, r) if held.rec_type == "request" else (r, held)))
            yield held
            yield r
            held = None
            continue
        if held is not None:
            yield held
        held = r
    if held is not None:
        yield held


def digest_of(path: str, offset: int, length: int) -> str:
    """sha256: and the hex digest of a stretch of a file; ValueError if the file ends before."""
    out, left = hashlib.sha256(), length
    with opened(path) as f:
        f.seek(offset)
        while left and (part := f.read(min(left, 1 << 16))):
            out.update(part)
            left -= len(part)
    if left:
        raise ValueError(f"{path}: {left} bytes of the record at {offset} are missing")
    return "sha256:" + out.hexdigest()


@dataclass
class _File(InputPartition):
    path: str
    rank: int

    def __init__(self, path: str, rank: int):
        self.path, self.rank, self.value = path, rank, rank


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.files = ordered(files_of(json.loads(options["paths"])))
        self.payload = options.get("payload", "true").lower() != "false"
        self.digest = options.get("digest", "false").lower() == "true"
        self.types = {t for t in options.get("types", "").split(",") if t}
        self.most = int(options.get("max_record_bytes", 1 << 31))

    def partitions(self):
        return [_File(p, i) for i, p in enumerate(self.files)]

    def read(self, partition):
        pairs = lambda h: [{"name": k, "value": v} for k, v in h]
        try:
            for i, r in enumerate(paired(records(partition.path, self.most))):
                if self.types and r.rec_type not in self.types:
                    continue
                yield (
                    partition.path, partition.rank, i, r.offset, r.length, r.rec_type, pairs(r.headers), r.status_line, None if r.http is None else pairs(r.http), r.method, r.urlkey, r.request_body,
                    r.payload if self.payload else None, len(r.payload), digest_of(partition.path, r.offset, r.length) if self.digest else None, r.error,
                )
        except (OSError, EOFError, gzip.BadGzipFile) as e:
            yield (partition.path, partition.rank, -1, 0, 0, None, [], None, None, None, None, None, None, 0, None, str(e))


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)


def read_warc(spark: SparkSession, paths: list[str], **options: str) -> DataFrame:
    """The records of files and folders, in no order of rows; (file_rank, rec_idx) tells the order of capture."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(paths=json.dumps(paths), **options).load()


def write_record(kind: str, headers: dict[str, str], block: bytes, compress: bool = True) -> bytes:
    """One record, for fixtures and exports."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    data = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(data) if compress else data


def write_archives(pages: DataFrame, folder: str, page_id: str, url: str, body: str, status: str, posted: str) -> int:
    """Writes a gzip member for each response, and before it one for its request where ``posted`` (a form) isn't null, a file a task; returns the number of responses.

    Names of files are given by partition, so a repeated attempt writes the same file again.
    """
    import pyarrow as pa

    source = pages.select(pages[page_id].alias("i"), pages[url].alias("u"), pages[body].alias("b"), pages[status].alias("s"), pages[posted].alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, at = _located(folder)
        name, n, out = f"{at}/part-{TaskContext.get().partitionId():06}.warc.gz", 0, None
        for b in batches:
            for i, u, html, code, form in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    if fs is None:
                        os.makedirs(at, exist_ok=True)
                    else:
                        fs.create_dir(at, recursive=True)
                    out = open(name, "wb") if fs is None else fs.open_output_stream(name, compression=None)
                head = {"WARC-Target-URI": u, "WARC-Date": "2021-01-01T00:00:00Z", "Content-Type": "application/http"}
                if form is not None:
                    request = f"POST / HTTP/1.1\r\nContent-Type: application/x-www-form-urlencoded\r\nContent-Length: {len(form.encode())}\r\n\r\n{form}"
                    out.write(write_record("request", {**head, "WARC-Record-ID": f"<urn:request:{i}>"}, request.encode()))
                    head["WARC-Concurrent-To"] = f"<urn:request:{i}>"
                block = f"HTTP/1.1 {code} X\r\nContent-Type: text/html\r\n\r\n".encode() + (html or "").encode()
                out.write(write_record("response", {**head, "WARC-Record-ID": f"<urn:page:{i}>"}, block))
                n += 1
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return sum(r.n for r in source.mapInArrow(run, "n long").collect())  # a number a task

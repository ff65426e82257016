"""WARC archives with a two-level capture index: compressed blocks of sorted URL keys under sparse directories."""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrecon.llm.common import new_path, written

#: Captures in one compressed block of the index.
CAPTURES = 2_000
#: Bytes of the archives that a task of the way back reads.
PART = 64 << 20
DATE = "2024-01-01T00:00:00Z"


def surt(url: str | None) -> str:
    """Sort key of a URL: host labels in reverse, then path and query; no scheme, www, port or fragment."""
    try:
        u = urlsplit((url or "").strip())
        host = (u.hostname or "").lower()
    except ValueError:
        return "-)/" + (url or "")
    host = re.sub(r"^www\d*\.", "", host)
    return ",".join(reversed(host.split("."))) + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def capture_key(url: str | None, page_id: int | None) -> str:
    key = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", surt(url))
    return f"{key} {'-' if page_id is None else format(page_id + 2**63, '020d')}"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, response: int | None) -> bytes:
    """One WARC record as a gzip member; response: the page it revisits, None for a response."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if response is None else b"")
    head = {
        "WARC-Type": "response" if response is None else "revisit",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or ""),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Page-Id": "" if page_id is None else str(page_id),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(body)),
    }
    if response is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(response), "X-Refers-To-Page": str(response)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    z = zlib.compressobj(3, wbits=31)
    return z.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + body + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> dict:
    """Headers and payload of one record; a response whose payload does not have its digest raises ValueError."""
    head, _, rest = zlib.decompress(member, wbits=31).partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    number = lambda x: int(x) if x else None
    return {
        "page_id": number(fields["X-Page-Id"]), "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": number(fields.get("X-Refers-To-Page")), "payload": payload,
    }


def _batch(rows: list[dict], names: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in names.items()], list(names))


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write an archive per task into folder (a URI all executors reach) and return the manifest: key, file, offset, length.

    pages: page_id, url, html (null: empty payload). Of records with equal payloads of at least min_bytes that with
    the largest page_id is the response and the others revisit it; smaller payloads are all responses. Rows with a
    null page_id, or that repeat the largest id, are responses too. A retried task writes a new file; only files of tasks
    that ended well are in the manifest.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("size", F.octet_length("html")).withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    first = p.groupBy("sha", "size").agg(F.max("page_id").alias("response"))
    p = p.join(first, ["sha", "size"])
    revisits = (F.col("size") >= min_bytes) & (F.col("page_id") < F.col("response"))
    p = p.select("page_id", "url", "html", F.when(revisits, F.col("response")).alias("response"))
    names = {"key": pa.string(), "file": pa.string(), "offset": pa.int64(), "length": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        name, at, out = f"part-{uuid.uuid4().hex}.warc.gz", 0, None
        for b in batches:
            rows = []
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                page_id, url, html, response = r
                member = record(page_id, url, html.encode(), response)
                out.write(member)
                rows.append({"key": capture_key(url, page_id), "file": name, "offset": at, "length": len(member)})
                at += len(member)
            if rows:
                yield _batch(rows, names)
        if out is not None:
            out.close()

    return written(p.mapInArrow(run, "key string, file string, offset long, length long"), "manifest")


def index(manifest: DataFrame, folder: str) -> list[tuple[str, str]]:
    """Write the index of a manifest into folder; return the top level: (first key, name) of each part, in order.

    A part holds a range of keys as compressed blocks, and beside them a directory with the first key and the place of
    each block. The top level has an entry per part, so its size follows the number of partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        name, at, out, lines, directory = f"part-{uuid.uuid4().hex}", 0, None, [], []

        def flush():
            nonlocal at, out
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}.cdx", compression=None)
            block = zlib.compress("\n".join(lines).encode(), 3)
            out.write(block)
            directory.append((lines[0].split("\t", 1)[0], at, len(block)))
            at += len(block)
            lines.clear()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                lines.append("\t".join(map(str, row)))
                if len(lines) == CAPTURES:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{root}/{name}.dir", compression=None) as f:
                f.write(json.dumps(directory).encode())
            yield _batch([{"first": directory[0][0], "name": name}], {"first": pa.string(), "name": pa.string()})

    rows = manifest.select("key", "file", "offset", "length").repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    return sorted((r.first_key, r.name) for r in rows.mapInArrow(run, "first string, name string").withColumnRenamed("first", "first_key").collect())


class Reader:
    """Finds captures by binary search in the levels of the index and reads their records by byte range."""

    def __init__(self, archives: str, folder: str, top: list[tuple[str, str]]):
        self.archives, self.folder, self.top = archives, folder, top
        self.firsts = [k for k, _ in top]
        self.directories: OrderedDict = OrderedDict()
        self.blocks: OrderedDict = OrderedDict()
        self.files: OrderedDict = OrderedDict()

    def _kept(self, cache: OrderedDict, key, make, most: int):
        if key in cache:
            cache.move_to_end(key)
        else:
            if len(cache) >= most:
                old = cache.popitem(last=False)[1]
                if hasattr(old, "close"):
                    old.close()
            cache[key] = make()
        return cache[key]

    def _open(self, folder: str, name: str):
        fs, root = pafs.FileSystem.from_uri(folder)
        return fs.open_input_file(f"{root}/{name}")

    def _range(self, folder: str, name: str, offset: int, length: int) -> bytes:
        return self._kept(self.files, (folder, name), lambda: self._open(folder, name), 64).read_at(length, offset)

    def _directory(self, name: str) -> list:
        def load():
            with self._open(self.folder, f"{name}.dir") as f:
                return json.loads(f.read())

        return self._kept(self.directories, name, load, 16)

    def _block(self, name: str, k: int) -> list[list[str]]:
        _, offset, length = self._directory(name)[k]
        return self._kept(self.blocks, (name, k), lambda: [x.split("\t") for x in zlib.decompress(self._range(self.folder, f"{name}.cdx", offset, length)).decode().split("\n")], 8)

    def find(self, key: str) -> Iterator[dict]:
        """The records of all captures with this key: part, then block, then line by binary search."""
        part = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while part < len(self.top) and self.firsts[part] <= key:
            name = self.top[part][1]
            directory = self._directory(name)
            k = max(0, bisect.bisect_left(directory, key, key=lambda d: d[0]) - 1)
            while k < len(directory) and directory[k][0] <= key:
                lines = self._block(name, k)
                for line in lines[bisect.bisect_left(lines, key, key=lambda x: x[0]) :]:
                    if line[0] != key:
                        break
                    yield parse(self._range(self.archives, line[1], int(line[2]), int(line[3])))
                k += 1
            part += 1


def read(pages: DataFrame, archives: str, folder: str, top: list[tuple[str, str]], size: int = 0) -> DataFrame:
    """The captures of pages (page_id, url), read back through the index: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to, payload. Keys go in order, so a task reads each block and archive range once.

    size: bytes of the records asked for, which decides the number of tasks: the keys are small beside what lies behind them.
    """
    kind = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    names = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([capture_key(u, i) for i, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], pa.string())], ["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(archives, folder, top)
        for b in batches:
            rows, size = [], 0
            for key in b.column(0).to_pylist():
                for r in reader.find(key):
                    rows.append(r)
                    size += len(r["payload"])
                if size > 8_000_000:
                    yield _batch(rows, names)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, names)

    wanted = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(keys, "key string").distinct()
    parts = max(pages.sparkSession.sparkContext.defaultParallelism, -(-size // PART))
    return wanted.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(run, kind)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archive every page, index the archives and read every record back; columns as in read().

    Null html is an empty payload, a null url an empty one; repeated rows come back as often as they were written.
    Empty input: no rows. Other columns are ignored.
    """
    spark = pages.sparkSession
    archives, folder = new_path(spark, "warc"), new_path(spark, "cdx")
    manifest = write(pages, archives, min_bytes)
    size = manifest.agg(F.sum("length")).first()[0] or 0
    return read(pages, archives, folder, index(manifest, folder), size)

"""WARC archives with a two-level capture index.

Writing: every page becomes one record, compressed by itself. Of records with equal payloads the
one with the smallest page_id is a response, the others are revisits that refer to it; the
smallest is found by an aggregation that Spark combines before its shuffle. Each task writes one
archive under a name of its own attempt, and only the index lines of attempts that Spark accepts
are kept, so an archive that a lost task left behind is never read.

Index: lines are sorted by reversed-host url key over all tasks and cut into compressed blocks of
`BLOCK_LINES` lines; a directory beside each index part has the first key, place and length of
each block. A lookup finds the part by its first and last key, searches the directory by bisection,
reads the blocks that can hold the key by range, and searches their lines by bisection. Records
are then read by range from the archives, in the order in which they lie there.

Files are written and read through pyarrow's file systems, below the folder that the cluster shares.

Defined results for odd rows: a null html is an empty payload, a null url is archived under the
empty key, and a null page_id counts as greater than any other. Rows that repeat the smallest
page_id of a payload are all responses. Other columns are not looked at. An empty table gives
empty archives and an empty result.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, partitions, stored, table
from .url_filter import host_of, path_of, query_of

BLOCK_LINES = 1024
LEVEL = 4
_DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("8f0d4ef0-5d0f-4c53-9d53-1d6f6f8f6a01")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def capture_key(url: Column) -> Column:
    """The url's sort key: the host's labels reversed, then path and query. Other text stays as it is."""
    reversed_host = F.array_join(F.reverse(F.split(host_of(url), r"\.")), ",")
    key = F.when(F.contains(url, F.lit("://")), F.concat(reversed_host, F.lit(")"), path_of(url), query_of(url))).otherwise(url)
    return F.coalesce(key, F.lit(""))


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _gunzip(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


def _clean(text: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    name = uuid.uuid5(_SPACE, f"{page_id} {url} {digest}")
    head = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", _DATE),
        ("WARC-Target-URI", _clean(url or "")), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", len(payload)),
        ("X-Page-Id", "" if page_id is None else page_id),
    ]
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-Id", "" if refers_to is None else refers_to)]
    block = _HTTP if revisit else _HTTP + payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers, and the payload that it holds."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _open(path: str):
    fs, at = pafs.FileSystem.from_uri(path)
    return fs, at


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0) -> DataFrame:
    """pages(page_id, url, html) -> a stored table of index lines (key, page_id, file, at, length)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    light = rows.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("size"))
    repeated = light.where(F.col("size") >= min_revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    full = rows.withColumn("digest", F.sha1("html")).join(repeated.withColumn("shared", F.lit(True)), "digest", "left")
    revisit = F.coalesce(F.col("shared"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))
    full = full.select("page_id", "url", "html", "digest", "first", revisit.alias("revisit"), capture_key(F.col("url")).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        file = f"{folder}/archive-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        out, at = None, 0
        for batch in batches:
            lines = []
            for page_id, url, text, digest, first, again, key in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    fs, path = _open(file)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                payload = text.encode("utf-8")
                name = base64.b32encode(bytes.fromhex(digest)).decode()
                data = _gzip(record(page_id, url, payload, name, first, again))
                out.write(data)
                lines.append((key, page_id, file, at, len(data)))
                at += len(data)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in lines], t) for i, t in enumerate(_LINE_TYPES)], ["key", "page_id", "file", "at", "length"])
        if out is not None:
            out.close()

    return stored(full.mapInArrow(run, _LINE), "captures")


_LINE = "key string, page_id long, file string, at long, length long"
_LINE_TYPES = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
_PART = "index string, directory string, first string, last string, blocks long"


def build_index(lines: DataFrame, folder: str, parts: int | None = None) -> DataFrame:
    """lines as of write_archives -> a stored table of index parts, a row per part."""
    order = ["key", "page_id", "file", "at"]
    spread = lines.repartitionByRange(parts or partitions(lines.sparkSession), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        stem = f"{folder}/index-{task.partitionId():06d}-{task.taskAttemptId()}"
        out = directory = None
        held: list[tuple] = []
        first = last = None
        at = blocks = 0

        def flush():
            nonlocal at, blocks, held
            data = _gzip("".join(json.dumps(x) + "\n" for x in held).encode())
            out.write(data)
            directory.write((json.dumps([held[0][0], at, len(data)]) + "\n").encode())
            at, blocks, held = at + len(data), blocks + 1, []

        for batch in batches:
            for line in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    fs, path = _open(stem)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out, directory = (fs.open_output_stream(path + end, compression=None) for end in (".cdx.gz", ".idx"))
                    first = line[0]
                held.append(line)
                last = line[0]
                if len(held) == BLOCK_LINES:
                    flush()
        if out is not None:
            if held:
                flush()
            out.close()
            directory.close()
            row = [[stem + ".cdx.gz"], [stem + ".idx"], [first], [last], [blocks]]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if i == 4 else pa.string()) for i, v in enumerate(row)], ["index", "directory", "first", "last", "blocks"])

    return stored(spread.mapInArrow(run, _PART), "index")


class Part:
    """One index part, read by range."""

    def __init__(self, index: str, directory: str):
        fs, path = _open(directory)
        with fs.open_input_stream(path, compression=None) as f:
            entries = [json.loads(x) for x in f.read().decode().splitlines()]
        self.first = [e[0] for e in entries]
        self.places = [(e[1], e[2]) for e in entries]
        fs, path = _open(index)
        self.file = fs.open_input_file(path)
        self.held: tuple[int, list] = (-1, [])

    def block(self, n: int) -> list:
        if self.held[0] != n:
            at, length = self.places[n]
            self.file.seek(at)
            self.held = (n, [json.loads(x) for x in _gunzip(self.file.read(length)).decode().splitlines()])
        return self.held[1]

    def find(self, key: str) -> Iterator[list]:
        n = max(0, bisect.bisect_left(self.first, key) - 1)  # the block before may end with the key
        while n < len(self.first) and self.first[n] <= key:
            lines = self.block(n)
            i = bisect.bisect_left(lines, key, key=lambda x: x[0])
            while i < len(lines) and lines[i][0] == key:
                yield lines[i]
                i += 1
            n += 1


def lookup(keys: DataFrame, parts: DataFrame) -> DataFrame:
    """keys(key) -> the index lines of all captures under these keys. The table of parts, a row per
    index file, is what every task holds; directories and blocks are read where they are needed."""
    known = sorted((r.first, r.last, r["index"], r.directory) for r in parts.collect())  # as many rows as build_index has partitions
    firsts = [x[0] for x in known]
    n = max(1, len(known))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key in batch.column(0).to_pylist():
                i = bisect.bisect_right(firsts, key) - 1
                while i >= 0 and known[i][1] >= key:
                    out.append((i, key))
                    i -= 1
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], ["part", "key"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = -1, None
        for batch in batches:
            out = []
            for i, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i != at:
                    at, part = i, Part(known[i][2], known[i][3])
                for line in part.find(key):
                    out.append(line)
                    if len(out) >= 10_000:
                        yield _lines(out)
                        out = []
            yield _lines(out)

    routed = keys.select(F.col("key").cast("string").alias("key")).where("key IS NOT NULL").distinct().mapInArrow(route, "part long, key string")
    return routed.repartitionByRange(n, "part", "key").sortWithinPartitions("part", "key").mapInArrow(read, _LINE)


def _lines(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(_LINE_TYPES)], ["key", "page_id", "file", "at", "length"])


_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def fetch(lines: DataFrame, payloads: bool = False) -> DataFrame:
    """Reads the records that index lines name, in the archives' order, and checks their payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = file = None
        for batch in batches:
            out = []
            for path, at, length in zip(*(c.to_pylist() for c in batch.columns)):
                if path != name:
                    fs, inside = _open(path)
                    name, file = path, fs.open_input_file(inside)
                file.seek(at)
                headers, payload = parsed(_gunzip(file.read(length)))
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                kind = headers["WARC-Type"]
                if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"{path} at {at}: the payload does not match its digest")
                number = lambda k: int(headers[k]) if headers.get(k) else None
                out.append((number("X-Page-Id"), headers["WARC-Target-URI"], number("X-Payload-Length"), digest, kind, number("X-Refers-To-Page-Id"), payload if kind == "response" else None))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            whole = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)
            yield whole if payloads else whole.select(names[:-1])

    spread = lines.select("file", "at", "length").repartitionByRange(partitions(lines.sparkSession), "file", "at").sortWithinPartitions("file", "at")
    return spread.mapInArrow(run, _RECORD + (", payload binary" if payloads else ""))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = fresh_path(spark, "warc")
    lines = write_archives(pages, folder)
    parts = build_index(lines, folder)
    wanted = pages.select(capture_key(F.col("url").cast("string")).alias("key"))
    return fetch(lookup(wanted, parts)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""

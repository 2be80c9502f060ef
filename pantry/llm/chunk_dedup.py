"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of every text; where its highest bits are zero, a chunk ends.
Where chunks end depends on the last 16 bytes alone, but for the least and the greatest length of
a chunk, so an insertion shifts no chunk further on. A chunk is a repeat if its 128-bit digest
occurs in a document with a smaller doc_id, or earlier in its own document. Neighbouring repeats
form runs, and runs of at least `min_run` bytes are removed: the short repeats that any two texts
of a language share by chance are not.

The first holder of a digest is found by an aggregation that Spark combines before its shuffle, so
a chunk that a third of all documents hold is one row per task there; the join that brings the
answer back is one that adaptive execution can split. Chunks are judged on the input.

Defined results for odd rows: a null text is an empty one, which has no chunks. A row without
doc_id comes after all others. Rows that share a doc_id are versions of one document and do not
make each other's chunks repeats; with equal texts they fare alike, and versions are told apart by 64
bits of a hash of the text. An empty table gives an empty result. A text is taken whole; a very long one
is a batch of its own. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_batches, table

LEAST, MOST, BITS = 16, 256, 5
LAST = 2**63 - 1


def _gear() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(27))) >> np.uint64(40)).astype(np.uint16)


GEAR = _gear()


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i - 1] + GEAR[raw[i]], modulo 2**16, by doubling the window."""
    h = GEAR[raw]
    for width in (1, 2, 4, 8):
        if len(h) > width:
            wider = h.copy()
            wider[width:] += h[:-width] << np.uint16(width)
            h = wider
    return h


def cuts(data: bytes) -> list[int]:
    """Where the chunks of data end."""
    n = len(data)
    out: list[int] = []
    last = 0
    ends = np.flatnonzero(gear_hashes(np.frombuffer(data, np.uint8)) < (1 << (16 - BITS))) + 1
    for end in [*ends.tolist(), n]:
        while end - last > MOST:
            last += MOST
            out.append(last)
        if end - last >= LEAST or (end == n and end > last):
            out.append(end)
            last = end
    return out


def _tag(text: Column) -> Column:
    return F.xxhash64(text)


def chunk_table(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc, tag, h1, h2, place), a row per chunk; tag is a hash of the text, place
    holds the start, the length less one, and whether the digest occurred before in the same text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for whole in batches:
            for batch in cut_batches(whole, 1, 1 << 20):
                counts, places, digests = [], [], []
                for text in batch.column(1).to_pylist():
                    data = text.encode("utf-8", "surrogatepass") if text else b""
                    ends = cuts(data)
                    starts = [0, *ends[:-1]]
                    own = [digest(data[a:b]) for a, b in zip(starts, ends)]
                    seen: set[bytes] = set()
                    for a, b, d in zip(starts, ends, own):
                        places.append(a << 9 | (b - a - 1) << 1 | (d in seen))
                        seen.add(d)
                    counts.append(len(own))
                    digests += own
                halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                doc, tag = (pa.array(np.repeat(batch.column(i).to_numpy(), counts)) for i in (0, 2))
                yield pa.RecordBatch.from_arrays([doc, tag, pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(places, pa.int64())], ["doc", "tag", "h1", "h2", "place"])

    text = F.col("text").cast("string")
    rows = docs.where("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), text.alias("text"), _tag(text).alias("tag"))
    return rows.mapInArrow(run, "doc long, tag long, h1 long, h2 long, place long")


def repeats(docs: DataFrame, min_run: int = 64) -> DataFrame:
    """docs(doc_id, text) -> (doc, tag, spans): the byte spans to remove, a row per text with any;
    doc is the doc_id, the greatest long for null."""
    chunks = chunk_table(docs)
    first = chunks.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    found = chunks.join(first, ["h1", "h2"]).where("first < doc OR place & 1 = 1")
    met = found.groupBy("doc", "tag").agg(F.collect_set("place").alias("places"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for places in batch.column(2).to_pylist():
                runs: list[list[int]] = []
                for p in sorted(places):
                    start, size = p >> 9, (p >> 1 & 255) + 1
                    if runs and runs[-1][1] == start:
                        runs[-1][1] += size
                    else:
                        runs.append([start, start + size])
                out.append([{"start": a, "end": b} for a, b in runs if b - a >= min_run])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], ["doc", "tag", "spans"])

    return met.mapInArrow(spans, "doc long, tag long, spans array<struct<start: long, end: long>>").where("size(spans) > 0")


def measured(docs: DataFrame, min_run: int = 64) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, spans), a row per row of docs."""
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), _tag(F.coalesce(text, F.lit(""))).alias("tag"),
    )
    joined = rows.join(repeats(docs, min_run), ["doc", "tag"], "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start: long, end: long>>"))
    return joined.select(
        "doc_id", "n_bytes", F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size(spans).cast("long").alias("n_spans"), spans.alias("spans"),
    )


def remove_repeats(docs: DataFrame, min_run: int = 64) -> DataFrame:
    """docs with the repeats taken out of `text`; a character that a span cuts goes as a whole."""
    found = repeats(docs, min_run)
    one, two, three = (f"_{n}_of_chunk_dedup" for n in ("doc", "tag", "spans"))
    text = F.col("text").cast("string")
    found = found.select(F.col("doc").alias(one), F.col("tag").alias(two), F.col("spans").alias(three))

    @F.pandas_udf("string")
    def left(texts, spans):
        def cut(text, runs):
            if text is None or runs is None:
                return text
            data, at, out = text.encode("utf-8"), 0, []
            for run in sorted((r["start"], r["end"]) for r in runs):
                out.append(data[at : run[0]].decode("utf-8", "ignore"))
                at = run[1]
            return "".join([*out, data[at:].decode("utf-8", "ignore")])

        return texts.__class__([cut(a, b) for a, b in zip(texts, spans)], dtype=object)

    rows = docs.join(found, (F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)) == F.col(one)) & (_tag(text) == F.col(two)), "left")
    return rows.select(*[left(text, F.col(three)).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def op7_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(table(spark, sf_dir, "documents"))

"""SimHash near-duplicate detection.

1. Every text gets a 64-bit fingerprint: a bit is 1 if it is set in over half of the XXH64 values
   of the text's word shingles.
2. Equal fingerprints fall together in one aggregation, so a group of copies of any size is one
   row from here on.
3. Pigeonhole blocks: the 64 bits are cut into `blocks` blocks. Fingerprints that differ in at most
   `max_bits` bits agree in at least `blocks - max_bits` whole blocks, so for one of the choices
   of that many blocks their key is equal. Each row is dealt out once per choice, rows that are
   alone under a key go, and the rest are compared.
4. Links found are Hamming distances verified on the whole fingerprints. A task returns links that
   connect what is connected among the rows it holds, not all pairs. A key with more than
   `chunk_rows` rows is cut into chunks, and every two chunks meet in a task of their own, so that
   no task holds more than two chunks and no pair is missed.
5. Components over the links.

Defined results for odd rows: a null text has no words, and like an empty one has fingerprint
zero, which links like any other. A row whose doc_id is null keeps its row and its links and names
no component. Repeated rows stay repeated. Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .components import connected_components

SEED = 42
BITS = 64


def shingle_hashes(text: str | None, shingle_words: int = 4) -> np.ndarray:
    """The XXH64 of each word shingle of a text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle_words + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist())), np.uint64, n)


def majority(values: np.ndarray) -> int:
    """The bits that are set in over half of the values; of none, zero."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(values), 1 << 16):
        counts += np.unpackbits(values[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(values)).tobytes(), "big")


def fingerprint(text: str | None, shingle_words: int = 4) -> int:
    """The fingerprint of one text as an unsigned integer."""
    return majority(shingle_hashes(text, shingle_words))


def with_fingerprints(docs: DataFrame, shingle_words: int = 4) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp), fp being the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_py(), shingle_words) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def block_keys(fp: Column, blocks: int, max_bits: int) -> Column:
    """An array with one long for each choice of `blocks - max_bits` blocks: the bits of the chosen
    blocks with the number of the choice above them."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - max_bits)):
        key = F.lit(0).cast("long")
        for b in chosen:
            width = edges[b + 1] - edges[b]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, edges[b]).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(key.bitwiseOR(F.lit(n << 48)))
    return F.array(*keys)


def _forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all of `fps` that links of at most max_bits bits connect."""
    left = np.arange(len(fps))
    us, vs = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= max_bits
            if near.any():
                found = left[near]
                left = left[~near]
                us.append(np.full(len(found), at))
                vs.append(found)
                queue.extend(found.tolist())
    if not us:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(us), np.concatenate(vs)


def _links_of_sorted(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """keys: an integer per row, equal ones side by side. Links within equal keys."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(first, len(keys)))
    pairs = first[sizes == 2]
    near = pairs[np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= max_bits]
    us, vs = [fps[near]], [fps[near + 1]]
    for a, n in zip(first[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        own = fps[a : a + n]
        u, v = _forest(own, max_bits)
        us.append(own[u])
        vs.append(own[v])
    return np.concatenate(us), np.concatenate(vs)


def links(fps: DataFrame, max_bits: int = 4, blocks: int = 7, chunk_rows: int = 4096) -> DataFrame:
    """fps(fp), distinct -> (u, v): verified links whose components are those of all pairs that
    differ in at most max_bits bits."""
    dealt = fps.select("fp", F.explode(block_keys(F.col("fp"), blocks, max_bits)).alias("key"))
    # Spark takes exploded rows for as few as those of `fps` and would broadcast keys that the driver cannot hold
    shared = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").hint("merge")
    chunks = f"cast(ceil(n / {chunk_rows}) AS int)"
    met = (
        dealt.join(shared, "key")
        .selectExpr("key", "fp", f"{chunks} AS c", f"cast(pmod(xxhash64(fp, 7), {chunks}) AS int) AS own")
        .selectExpr("key", "fp", "own", "explode(CASE WHEN c = 1 THEN array(0) ELSE sequence(0, c - 1) END) AS other")
        .selectExpr("key", "least(own, other) AS a", "greatest(own, other) AS b", "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(rows)
            key, a, b, fp = (whole.column(i).to_numpy() for i in range(4))
            change = np.concatenate(([0], np.cumsum((key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
            u, v = _links_of_sorted(change, fp.astype(np.int64).view(np.uint64), max_bits)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(i)[batch.num_rows - 1].as_py() for i in range(3)]
            same = np.ones(batch.num_rows, bool)
            for i in range(3):
                same &= batch.column(i).to_numpy() == last[i]
            tail = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            if tail:
                held.append(batch.slice(0, tail))
            if tail or (held and [held[0].column(i)[0].as_py() for i in range(3)] != last):
                yield found(held)
                held = []
            held.append(batch.slice(tail))
        if held:
            yield found(held)

    return (
        met.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "fp")
        .mapInArrow(run, "u long, v long").distinct()
    )


def near_duplicates(docs: DataFrame, shingle_words: int = 4, max_bits: int = 4, blocks: int = 7, chunk_rows: int = 4096) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fingerprint, component_id), a row per row of docs;
    component_id is the smallest doc_id that can be reached over links, the row's own included."""
    marked = stored(with_fingerprints(docs, shingle_words), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(distinct.select("fp"), max_bits, blocks, chunk_rows))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that stay: of each component the row with the smallest doc_id. Rows without
    a doc_id stay, as nothing names them."""
    found = near_duplicates(docs, **parameters)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

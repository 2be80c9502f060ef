"""Benchmark decontamination by winnowing.

A document word is hit if it lies in an occurrence of `window` consecutive words of a benchmark
item (of a shorter item: of all its words). Hashes of `gram` consecutive words are winnowed: of
every `window - gram + 1` neighbouring hashes the smallest is kept, so any shared span of `window`
words has a kept hash on both sides. Where a document has a kept hash that the benchmark has as
well, the hit is extended to the windows around it: each is looked up by a hash of all its words
among the benchmark's distinct windows, and neighbouring finds are verified together, on the words
themselves. A window that an item or a document repeats is looked up once a place, whatever the number
of places it has on the other side. Items below `window` words, for which winnowing guarantees nothing,
are matched by one hash over all their words, for each of the lengths that occurs (`window - 1` at most).

The benchmark's side is joined in blocks, each broadcast by itself: items are taken until their
texts hold 3 * `block_words` * 2 characters, so a block has at most 3 * `block_words` words (of
one letter; of ordinary words about `block_words`) or is one longer item. That bound does not grow
with either table. With one block documents are read once and nothing is shuffled. With more,
documents get a row number, each block is a pass over them that returns only spans found, and the
spans of a row meet at the end.

`remove_contaminated`, the form for a corpus, has a stricter rule than the flag `contaminated`, which
asks for a twentieth of a document's words: no document that stays holds a window of the benchmark,
however long the document is.

Defined results for odd rows: a null or empty text has no words, is never hit, and is not
contaminated; an item without words or without item_id takes no part. Item rows that share an
item_id count as one item. Repeated documents stay repeated. Other columns are not looked at. Of
empty documents comes an empty result, with an empty benchmark nothing is hit. Texts are taken whole;
a very long one is a batch of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_batches, stored, table

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD6E8FEB86659FD93
_SEGMENT = 1 << 20
#: Bytes of text that are looked at together, or one longer text.
SLICE = 2 << 20
_NONE = np.uint64(2**64 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP = _powers(_BASE, 2 * _SEGMENT)
_DOWN = _powers(pow(_BASE, -1, 2**64), 2 * _SEGMENT)


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """data: lower-cased UTF-8 -> starts, ends and hashes of its words."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = _WORD[raw]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        a = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, a + _SEGMENT, "right")))
        n = int(ends[to - 1] - a)
        up, down = (_UP, _DOWN) if n < len(_UP) else (_powers(_BASE, n + 1), _powers(pow(_BASE, -1, 2**64), n + 1))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((raw[a : a + n].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        s, e = starts[at:to] - a, ends[at:to] - a
        hashes[at:to] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        at = to
    return starts, ends, _mix(hashes)


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for every n consecutive words (as many as there are)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    step = np.uint64(_STEP)
    for j in range(n):
        out = out * step + hashes[j : j + m]
    return _mix(out)


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of every n neighbours."""
    width = 1
    while 2 * width <= n:
        values = np.minimum(values[: len(values) - width], values[width:])
        width *= 2
    if width < n:
        values = np.minimum(values[: len(values) - (n - width)], values[n - width :])
    return values


def _lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


class Index:
    """One block of the benchmark: kept hashes, and the distinct windows with the items that have them."""

    def __init__(self, items: list[tuple[str, str]], window: int, gram: int):
        self.window, self.gram = window, gram
        self.ids: list[str] = []
        self.words: list[list[bytes]] = []
        none = np.zeros(0, np.uint64)
        kept, every, of, at = [none], [none], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        short: dict[int, dict[tuple[bytes, ...], set[int]]] = {}
        for item_id, text in items:
            data = _lowered(text)
            starts, ends, hashes = words_of(data)
            if not len(hashes):
                continue
            n = len(self.ids)
            self.ids.append(item_id)
            self.words.append([data[a:b] for a, b in zip(starts.tolist(), ends.tolist())])
            if len(hashes) < window:
                short.setdefault(len(hashes), {}).setdefault(tuple(self.words[n]), set()).add(n)
            else:
                kept.append(np.unique(_least(_grams(hashes, gram), window - gram + 1)))
                every.append(_grams(hashes, window))
                of.append(np.full(len(every[-1]), n))
                at.append(np.arange(len(every[-1])))
        self.kept = np.unique(np.concatenate(kept))
        keys, of, at = (np.concatenate(x) for x in (every, of, at))
        # windows by hash, those of one hash in order of place: the first stands for it
        order = np.argsort(keys, kind="stable")
        keys, of, at = keys[order], of[order], at[order]
        head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)])
        self.keys, self.item, self.place = keys[head], of[head], at[head]
        key_of = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(keys))))
        #: other windows that have the hash of a different one before them
        self.odd: dict[int, list[tuple[list[bytes], set[int]]]] = {}
        same = np.ones(len(keys), bool)
        for i in np.flatnonzero(np.concatenate(([False], keys[1:] == keys[:-1]))[: len(keys)]).tolist():
            k = int(key_of[i])
            own = self.words[of[i]][at[i] : at[i] + window]
            if own != self.words[self.item[k]][self.place[k] : self.place[k] + window]:
                same[i] = False
                others = self.odd.setdefault(k, [])
                known = next((x for x in others if x[0] == own), None) or others.append((own, set())) or others[-1]
                known[1].add(int(of[i]))
        self.first = np.searchsorted(key_of[same], np.arange(len(head) + 1))  # the items of each window, one after another
        self.items = of[same]
        self.short = {}
        for n, found in short.items():
            hashed: dict[int, list[tuple[tuple[bytes, ...], set[int]]]] = {}
            for own, ids in found.items():
                data = b" ".join(own)
                hashed.setdefault(int(_grams(words_of(data)[2], n)[0]), []).append((own, ids))
            self.short[n] = (np.array(sorted(hashed), np.uint64), hashed)


def _in(values: np.ndarray, table_: np.ndarray) -> np.ndarray:
    if not len(table_):
        return np.zeros(len(values), bool)
    return table_[np.minimum(np.searchsorted(table_, values), len(table_) - 1)] == values


def find(texts: list[str | None], index: Index) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """For each text: its number of words, spans of hit words, and ids of the items that hit them."""
    datas = [_lowered(t) for t in texts]
    data = b"\0".join(datas)
    starts, ends, hashes = words_of(data)
    bounds = np.cumsum([0] + [len(d) + 1 for d in datas])
    first = np.searchsorted(starts, bounds)  # of each text
    out: list = [(int(b - a), [], set()) for a, b in zip(first, first[1:])]
    doc = np.repeat(np.arange(len(texts)), np.diff(first)) if len(texts) else np.zeros(0, np.int64)
    size = index.window

    def words(i: int, j: int) -> list[bytes]:
        return [data[a:b] for a, b in zip(starts[i:j].tolist(), ends[i:j].tolist())]

    def add(k: int, i: int, j: int) -> None:
        lo = int(first[k])
        spans = out[k][1]
        if spans and i - lo <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], j - lo))
        else:
            spans.append((i - lo, j - lo))

    if len(hashes) >= size and len(index.kept):
        least = _least(_grams(hashes, index.gram), size - index.gram + 1)
        at = np.flatnonzero(_in(least, index.kept))
        at = at[doc[at] == doc[at + size - 1]]
        sums = np.zeros(len(at), np.uint64)  # of the windows there, as _grams has them
        for j in range(size):
            sums = sums * np.uint64(_STEP) + hashes[at + j]
        sums = _mix(sums)
        key = np.minimum(np.searchsorted(index.keys, sums), len(index.keys) - 1)
        hit = index.keys[key] == sums
        at, key = at[hit], key[hit]
        item, place = index.item[key], index.place[key]
        go_on = (at[1:] == at[:-1] + 1) & (item[1:] == item[:-1]) & (place[1:] == place[:-1] + 1) & (doc[at[1:]] == doc[at[:-1]])
        head = np.flatnonzero(np.concatenate(([True], ~go_on))[: len(at)])
        found = np.zeros(len(at), bool)
        ids: dict[int, set[int]] = {}
        for a, b in zip(head.tolist(), np.append(head[1:], len(at)).tolist()):
            i, j, q = int(at[a]), int(at[b - 1]) + size, int(place[a])
            if words(i, j) == index.words[item[a]][q : q + j - i]:
                found[a:b] = True
            else:  # equal hashes of different words
                for x in range(a, b):
                    q = int(place[x])
                    found[x] = words(int(at[x]), int(at[x]) + size) == index.words[item[x]][q : q + size]
            for x in range(a, b) if index.odd else ():
                own = next((y for w, y in index.odd.get(int(key[x]), ()) if w == words(int(at[x]), int(at[x]) + size)), None)
                if own is not None:
                    ids.setdefault(int(doc[at[x]]), set()).update(own)
                    add(int(doc[at[x]]), int(at[x]), int(at[x]) + size)
        at, key = at[found], key[found]
        for i in at.tolist():
            add(int(doc[i]), i, i + size)
        pairs = np.unique(np.stack([doc[at], key], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
        for k, w in pairs.tolist():
            ids.setdefault(k, set()).update(index.items[index.first[w] : index.first[w + 1]].tolist())
        for k, own in ids.items():
            out[k][2].update(index.ids[n] for n in own)
    for n, (keys, items) in index.short.items():
        grams = _grams(hashes, n)
        at = np.flatnonzero(_in(grams, keys))
        at = at[doc[at] == doc[at + n - 1]]
        for p in at.tolist():
            own = tuple(words(p, p + n))
            for those, ids_ in items[int(grams[p])]:
                if those == own:
                    lo = int(first[doc[p]])
                    out[doc[p]][1].append((p - lo, p - lo + n))
                    if not out[doc[p]][2].issuperset(index.ids[x] for x in ids_):
                        out[doc[p]][2].update(index.ids[x] for x in ids_)
    return out


def _summary(n_words: int, spans, items) -> tuple:
    hit = end = 0
    for a, b in sorted(spans):
        hit += max(0, b - max(a, end))
        end = max(end, b)
    names = sorted(items)
    return n_words, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0 and 20 * hit >= n_words


def blocks_of(benchmark: DataFrame, window: int, gram: int, block_words: int) -> Iterator[Index]:
    """The benchmark row by row; at most one block is held."""
    items: list[tuple[str, str]] = []
    n = 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("item_id IS NOT NULL AND text IS NOT NULL")
    for item_id, text in rows.toLocalIterator():
        size = len(text) // 2 + 1  # no text has more words
        if items and n + size > 3 * block_words:
            yield Index(items, window, gram)
            items, n = [], 0
        items.append((item_id, text))
        n += size
    if items:
        yield Index(items, window, gram)


_FOUND = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    return [pa.array([r[i] for r in rows], kinds[i]) for i in range(5)]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, gram: int = 5, block_words: int = 500_000) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> (doc_id, n_words, n_hit, n_items,
    items_sha256, contaminated), a row per row of docs."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = blocks_of(benchmark, window, gram, block_words)
    index = next(blocks, None) or Index([], window, gram)
    another = next(blocks, None)
    names = [x.split()[0] for x in _FOUND.split(", ")]
    if another is None:
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in cut_batches(whole, 1, SLICE):
                    got = [_summary(*x) for x in find(batch.column(1).to_pylist(), shared.value)]
                    yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(got)], names)

        return rows.mapInArrow(run, _FOUND)

    numbered = stored(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    passes = []
    while index is not None:
        shared, last = spark.sparkContext.broadcast(index), not passes

        def spans(batches: Iterator[pa.RecordBatch], shared=shared, everything=last) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in cut_batches(whole, 1, SLICE):
                    got = [(r, n, [x for s in sp for x in s], sorted(it)) for r, (n, sp, it) in zip(batch.column(0).to_pylist(), find(batch.column(1).to_pylist(), shared.value)) if sp or everything]
                    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], k) for i, k in enumerate(kinds)], ["row", "n_words", "spans", "items"])

        passes.append(stored(numbered.select("row", "text").mapInArrow(spans, "row long, n_words long, spans array<long>, items array<string>"), "spans"))
        shared.unpersist()
        index, another = another, next(blocks, None) if another is not None else None
    found = passes[0]
    for more in passes[1:]:
        found = found.union(more)
    met = found.groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_summary(n, zip(s[::2], s[1::2]), it) for n, s, it in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(got)], names)

    return numbered.select("row", "doc_id").join(met, "row").select("doc_id", "n_words", "spans", "items").mapInArrow(finish, _FOUND)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, gram: int = 5, block_words: int = 500_000) -> DataFrame:
    """The rows of docs that hold no window of the benchmark (and of no item below `window` words all
    of it), in docs' own columns. Rows are judged one by one, those without a doc_id as well; nothing is
    shuffled. Each block of the benchmark but the last is a pass over the rows that are left."""
    spark = docs.sparkSession
    blocks = blocks_of(benchmark, window, gram, block_words)
    index, left, text = next(blocks, None), docs, docs.columns.index("text")
    passes: list[DataFrame] = []
    while index is not None:
        shared = spark.sparkContext.broadcast(index)
        index = next(blocks, None)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in cut_batches(whole, text, SLICE):
                    yield batch.filter(pa.array([not spans for _, spans, _ in find(batch.column(text).to_pylist(), shared.value)], pa.bool_()))

        left = left.mapInArrow(clean, docs.schema)
        if index is not None:
            left = stored(left, "clean", *passes[-1:])
            passes.append(left)
    return left


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

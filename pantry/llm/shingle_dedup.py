"""Near duplicates by the Jaccard similarity of word shingles.

1. A text is the set of the XXH64 values of its word shingles (those of simhash_dedup). Texts
   with equal sets fall together in one aggregation and are one node from here on.
2. Candidates by SimHash: every text has its fingerprint of simhash_dedup, over the shingles of this stage, and the
   pigeonhole blocks there find what differs in at most `max_bits` bits. Each link found is decided on the whole
   sets, so a fingerprint alone links nothing. A SimHash of 64 bits does not reach down to 0.8: such pairs differ
   in 10 bits on average and often in 16, and then only single blocks of 4 bits are sure to agree. The rest of the
   pairs are found by 3 and 4.
3. MinHash in `bands` bands of `rows` values. A pair at similarity s shares a band with
   probability 1 - (1 - s^rows)^bands: at 0.8 all but 3 in a million pairs do, above it more. The texts of
   a band are held against one of them, as far as nothing connects them yet.
4. What shares a band and is not connected by then goes through a prefix filter, which loses nothing: with
   shingles in any one order, two sets at 0.8 share one of the first fifth (and one more) of either. The order
   is by frequency, the rare first, so that texts which have a frequent passage or a common origin in common,
   and less than 0.8 on the whole, mostly share none. Frequencies are counts by hash in SLOTS slots, a table
   of fixed size that is broadcast; what it blurs only costs time. Texts with a common rare shingle are again
   held against one of them, and then, as far as nothing connects them yet, against each other. The join that makes
   the latter pairs leaves out those that cannot be at 0.8: each set has a bitmap of the parity of its values by
   hash, and two sets differ in as many values at least as their bitmaps in bits (Sandes et al., "A bitmap filter
   for set similarity joins", 2020). So what goes on to be compared as sets no longer grows with the square
   of a group of such texts, as long as they have up to about 1,000 shingles; the join still meets those pairs itself.
5. Every candidate pair is decided on the whole sets, so nothing below the bound is linked. A pair is passed
   over only if links connect it already, so the components are those of all candidate pairs.
6. Components over the links.

Defined results for odd rows: null, empty and blank texts have the empty set, and are equal to each
other and similar to nothing else. A text with fewer words than a shingle is one shingle. Rows
without a doc_id link, but name no component. Sets are named by 64 bits of hash. An empty table gives an
empty result. Texts are taken whole, long ones in a batch of their own. Repeated rows stay repeated.
Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash_dedup
from .common import cut_batches, forget, stored
from .components import connected_components

SEED = 42
SLOTS = 1 << 18
#: Longs in a set's bitmap.
MARKS = 8


def shingles(text: str | None, shingle_words: int = 5) -> np.ndarray:
    """The set of a text, sorted."""
    return np.unique(simhash_dedup.shingle_hashes(text, shingle_words))


def node(values: np.ndarray) -> int:
    """A signed long that names a set."""
    return xxhash.xxh64_intdigest(values.tobytes(), SEED) - 2**63


def marks(values: np.ndarray) -> np.ndarray:
    """A bitmap of 64 * MARKS bits, each the parity of the values whose top bits name it."""
    n = 64 * MARKS
    odd = np.bincount((values >> np.uint64(65 - n.bit_length())).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def band_keys(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """A row of keys for each set, none of which may be empty."""
    rng = np.random.default_rng(SEED)
    odd = rng.integers(0, 2**64, (2, bands, rows), dtype=np.uint64) | np.uint64(1)
    salt = rng.integers(0, 2**64, bands, dtype=np.uint64)
    out = np.zeros((len(sets), bands), np.uint64)
    if not sets:
        return out
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    for i in range(bands):
        for j in range(rows):
            out[:, i] += np.minimum.reduceat(flat * odd[0, i, j], starts) * odd[1, i, j]
    return out ^ salt


def with_bands(docs: DataFrame, shingle_words: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut_batches(whole, 2, 1 << 20):
                hashes = [simhash_dedup.shingle_hashes(x.as_py(), shingle_words) for x in batch.column(2)]
                sets = [np.unique(h) for h in hashes]
                fps = np.array([simhash_dedup.majority(h) for h in hashes], np.uint64).view(np.int64)
                some = [i for i, s in enumerate(sets) if len(s)]
                keys = band_keys([sets[i] for i in some], bands, rows).view(np.int64)
                each: list = [[] for _ in sets]
                for i, k in zip(some, keys):
                    each[i] = k
                got = [pa.array([node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(fps), pa.array(each, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *got], ["doc_id", "tag", "node", "n", "fp", "bands"])

    text = F.col("text").cast("string")
    tagged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    return tagged.mapInArrow(run, "doc_id long, tag long, node long, n int, fp long, bands array<long>")


def near_fingerprints(marked: DataFrame, max_bits: int, blocks: int) -> DataFrame:
    """marked(node, n, fp) -> pairs (node, n, other, m) that connect all nodes which fingerprints that differ in at most
    max_bits bits connect. The empty set takes no part."""
    own = marked.where("n > 0").select("node", "n", "fp").distinct()
    least = own.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("l")).selectExpr("fp", "l.node AS other", "l.n AS m")
    equal = own.join(least, "fp").select("node", "n", "other", "m")
    found = simhash_dedup.links(least.select("fp"), max_bits, blocks)
    one = least.selectExpr("fp AS u", "other AS node", "m AS n")
    return equal.union(found.join(one, "u").join(least.withColumnRenamed("fp", "v"), "v").select("node", "n", "other", "m")).where("node <> other")


def sets_of(docs: DataFrame, chosen: DataFrame, shingle_words: int) -> DataFrame:
    """(node, shingles, marks) of the texts that chosen(doc_id, tag) names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut_batches(whole, 0, 1 << 20):
                sets = [shingles(x.as_py(), shingle_words) for x in batch.column(0)]
                lists = (pa.array(x, pa.list_(pa.int64())) for x in ([s.view(np.int64) for s in sets], [marks(s) for s in sets]))
                yield pa.RecordBatch.from_arrays([pa.array([node(s) for s in sets], pa.int64()), *lists], ["node", "shingles", "marks"])

    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text).alias("_tag"), text.alias("text"))
    found = texts.join(chosen, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_tag") == F.col("tag")), "left_semi")
    return found.select("text").mapInArrow(run, "node long, shingles array<long>, marks array<long>").dropDuplicates(["node"])


def frequencies(sets: DataFrame) -> np.ndarray:
    """How many shingles of the sets fall into each of SLOTS slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        for batch in batches:
            n += np.bincount(batch.column(0).flatten().to_numpy() & (SLOTS - 1), minlength=SLOTS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["slot", "n"])

    out = np.zeros(SLOTS, np.int64)
    met = sets.select("shingles").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    for r in met.toLocalIterator():  # SLOTS rows at most
        out[r.slot] = r.n
    return out


def prefix(values: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The first of a set's values, the rare first, as many as sets at `percent` must share one of."""
    n = len(values)
    keep = n - -(-percent * n // 100) + 1
    return values[np.lexsort((values, counts[values & (SLOTS - 1)]))[: min(keep, n)]]


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(key, node, n): a row for each value of a set's prefix that another set's prefix has as well."""
    counts = sets.sparkSession.sparkContext.broadcast(frequencies(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            found = [prefix(lists[i].values.to_numpy(), counts.value, percent) for i in range(batch.num_rows)]
            many = [len(f) for f in found]
            keys = np.concatenate([np.zeros(0, np.int64), *found])
            node_, n = (pa.array(np.repeat(x, many)) for x in (batch.column(0).to_numpy(), np.diff(np.asarray(lists.offsets))))
            yield pa.RecordBatch.from_arrays([pa.array(keys), node_, n.cast(pa.int32())], ["key", "node", "n"])

    dealt = stored(sets.select("node", "shingles").mapInArrow(run, "key long, node long, n int"), "prefixes")
    several = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("key")
    return stored(dealt.join(several, "key"), "prefixes", dealt)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets have at least `percent` of their union in common."""
    one, two = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"of_{x}")) for x in ("u", "v"))
    both = F.size(F.array_intersect("of_u", "of_v")).cast("long")
    return pairs.join(one, "u").join(two, "v").where((100 + percent) * both >= percent * (F.size("of_u") + F.size("of_v")).cast("long")).select("u", "v")


def _grouped(shared: DataFrame, roots: DataFrame | None) -> DataFrame:
    """shared(key, node, n) with the root of each node."""
    if roots is None:
        return shared.withColumn("root", F.col("node"))
    return shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _unconnected(now: DataFrame) -> DataFrame:
    """The rows of keys that have more than one root."""
    mixed = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    return now.join(mixed.select("key"), "key")


def may_be_similar(percent: int):
    """Whether sets of n and m values with the bitmaps `marks` and `of_other` can have `percent` of their union in common:
    they then differ in (n + m) * (100 - percent) / (100 + percent) values at most."""
    differ = sum(F.bit_count(F.get("marks", F.lit(i)).bitwiseXOR(F.get("of_other", F.lit(i)))) for i in range(MARKS))
    return (100 + percent) * differ.cast("long") <= (100 - percent) * (F.col("n") + F.col("m")).cast("long")


class Links:
    """Pairs that have been tried, and the components (node, root) of those that are similar."""

    def __init__(self, sets: DataFrame, percent: int):
        self.sets, self.percent = sets, percent
        self.tried: DataFrame | None = None
        self.roots: DataFrame | None = None

    def _try(self, met: DataFrame) -> None:
        percent = self.percent
        pairs = met.where(f"root <> its AND 100L * least(n, m) >= {percent}L * greatest(n, m)").selectExpr("least(node, other) AS u", "greatest(node, other) AS v").distinct()
        pairs = stored(pairs if self.tried is None else pairs.join(self.tried, ["u", "v"], "left_anti"), "pairs")
        if self.roots is not None and pairs.isEmpty():
            return
        found = stored(verified(pairs, self.sets, percent), "links")
        edges = found if self.roots is None else found.union(self.roots.selectExpr("node AS u", "root AS v"))
        self.tried = pairs if self.tried is None else self.tried.union(pairs)
        done = [found] if self.roots is None else [found, self.roots]
        self.roots = stored(connected_components(edges), "roots", *done)

    def near(self, pairs: DataFrame) -> None:
        """pairs(node, n, other, m), the first to be tried."""
        self._try(pairs.withColumns({"root": F.col("node"), "its": F.col("other")}))

    def star(self, shared: DataFrame, turn: int) -> None:
        """Of each key, every node with one of them."""
        now = _grouped(shared, self.roots)
        centre = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("other"), F.col("n").alias("m"), F.col("root").alias("its")))
        mixed = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), centre.alias("c")).where("lo < hi")
        self._try(now.join(mixed.select("key", "c.other", "c.m", "c.its"), "key"))

    def rest(self, shared: DataFrame) -> None:
        """Of each key, all pairs of nodes that nothing connects yet."""
        open_ = stored(_unconnected(_grouped(shared, self.roots)).join(self.sets.select("node", "marks"), "node"), "open")
        other = open_.selectExpr("key", "node AS other", "n AS m", "root AS its", "marks AS of_other")
        self._try(open_.join(other, "key").where("node < other").where(may_be_similar(self.percent)))
        forget(open_)


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, max_bits: int = 4, blocks: int = 7) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, component_id), a row per row of docs; component_id is the
    smallest doc_id that can be reached over pairs at `percent` or more, the row's own included."""
    marked = stored(with_bands(docs, shingle_words, bands, rows), "bands")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag"))
    distinct = marked.groupBy("node").agg(first.alias("t")).select("node", F.col("t.doc_id").alias("doc_id"), F.col("t.tag").alias("tag"))
    near = stored(near_fingerprints(marked, max_bits, blocks), "near")
    dealt = marked.select("node", "n", F.explode("bands").alias("key")).distinct()
    several = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("key")
    shared = stored(dealt.join(several, "key"), "shared")
    met = shared.select("node").union(near.select("node")).union(near.select("other")).distinct()
    chosen = distinct.join(met, "node", "left_semi").select("doc_id", "tag")
    sets = stored(sets_of(docs, chosen, shingle_words), "sets")
    links = Links(sets, percent)
    links.near(near)
    links.star(shared, 0)
    left = stored(_unconnected(_grouped(shared, links.roots)).select("node").distinct(), "left")
    of_left = stored(sets.join(left, "node", "left_semi"), "sets", left, shared, near)
    rare = prefixes(of_left, percent)
    links.star(rare, 1)
    links.rest(rare)
    forget(sets, of_left, rare)
    named = distinct.join(links.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return marked.select("doc_id", "node").join(named.join(least, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that stay: of each component the row with the smallest doc_id. Rows without
    a doc_id stay, as nothing names them."""
    found = near_duplicates(docs, **parameters)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)

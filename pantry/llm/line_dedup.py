"""Line dedup by pairwise alignment.

1. Lines of at least `min_chars` characters are anchors. An anchor is a line with its number among
   equal lines of its document, so it is unique there, as patience diff wants it. A shorter line is no
   anchor by itself; it is one together with the lines up to the nearest anchor above, and with those
   down to the nearest below.
2. Documents overlap where they share an anchor. A document is paired with the first holder (the
   smallest doc_id) of each of its anchors, rare or frequent, so no line is left out for being frequent
   and nothing grows with the square of a group. A pair carries its shared anchors and where they stand
   in either document, no text and no list of lines.
3. Each pair is aligned by patience: the longest chain of anchors that rises in both documents, then,
   for passages that have moved, chains through what is left. Neighbours on a chain that are neighbours
   in both documents are a block, and blocks are deleted from the later document.

Chains go on until no shared anchor is left, so whatever a document shares with an earlier one lies
in a block of that pair, and every anchor that any earlier document holds is shared with its first
holder as well. The blocks of the pairs that are aligned therefore cover the same lines as those of
all overlapping pairs (tests hold them against each other). A line that a document has more often
than any earlier one keeps the occurrences beyond that.

The lines that most documents share, HOT at most, are looked up in a broadcast table, so that no task
of the join gets all rows of one of them: any other line has less than one in HOT of all rows.

Documents are judged as they came in, not by what is left of earlier ones.

Defined results for odd rows: a null text has no lines and stays null; an empty text has one empty
line. A row without doc_id is left alone and pairs with nothing. Rows that share a doc_id are
versions of one document: they are not compared with each other, and later documents are compared
with each of them; if their texts are equal they fare alike. Lines end at \\n only. An empty table
gives an empty one. Texts are taken whole, whatever their length, one at a time. Other columns pass
through; where one is named like an added one, the added one takes its place.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_batches, stored, table

#: Lines that are looked up by broadcast: a bound on that table's rows.
HOT = 1000


def patience(pairs: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """pairs(place in a, place in b) of things that are unique in both -> chains that rise in both,
    the first of them as long as possible, the others through what it leaves; none is left out."""
    pairs = sorted(pairs, key=lambda p: p[1])
    if all(p[0] < q[0] for p, q in zip(pairs, pairs[1:])):
        return [pairs] if pairs else []
    tops: list[int] = []  # the longest chain that rises in both
    ends: list[int] = []
    before: list[int] = []
    for n, (x, _) in enumerate(pairs):
        p = bisect.bisect_left(tops, x)
        before.append(ends[p - 1] if p else -1)
        tops[p : p + 1], ends[p : p + 1] = [x], [n]
    on, n = [], ends[-1]
    while n >= 0:
        on.append(n)
        n = before[n]
    chains = [[pairs[n] for n in reversed(on)]]
    taken = set(on)
    heads: list[int] = []  # less the last place in a of each further chain, rising
    more: list[list[tuple[int, int]]] = []
    for n, (x, y) in enumerate(pairs):
        if n not in taken:
            p = bisect.bisect_right(heads, -x)
            if p == len(heads):
                heads.append(-x)
                more.append([(x, y)])
            else:
                heads[p] = -x
                more[p].append((x, y))
    return chains + more


def blocks_of(chain: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start in a, start in b, lines) of each run of neighbours."""
    out: list[tuple[int, int, int]] = []
    for x, y in chain:
        if out and (x, y) == (out[-1][0] + out[-1][2], out[-1][1] + out[-1][2]):
            out[-1] = (*out[-1][:2], out[-1][2] + 1)
        else:
            out.append((x, y, 1))
    return out


def _long_enough(line: bytes, min_chars: int) -> bool:
    line = line.strip(b" ")
    return len(line) >= min_chars and (len(line) >= 4 * min_chars or len(line.decode("utf-8", "surrogatepass")) >= min_chars)


def anchors(data: bytes, min_chars: int) -> list[tuple[int, bytes]]:
    """(line number, 16 bytes) of a text's anchors."""
    digest = xxhash.xxh3_128_digest
    seen: dict[bytes, int] = {}
    out: list[tuple[int, bytes]] = []
    small: list[tuple[int, bytes]] = []  # shorter lines since the last anchor
    above = b""

    def below(name: bytes) -> None:
        for at, line in reversed(small):
            name = digest(name + line + b">")
            out.append((at, name))

    for at, line in enumerate(data.split(b"\n")):
        name = digest(line)
        if _long_enough(line, min_chars):
            k = seen.get(name, 0)
            seen[name] = k + 1
            if k:
                name = digest(name + k.to_bytes(8, "little"))
            out.append((at, name))
            below(name)
            above = name
            small.clear()
        else:
            small.append((at, name))
            if above:
                above = digest(above + name + b"<")
                out.append((at, above))
    return out


def _tag(text: Column) -> Column:
    return F.xxhash64(text)


def anchor_table(docs: DataFrame, min_chars: int) -> DataFrame:
    """docs(doc_id, text) -> (doc, tag, at, a, b): a row per anchor; tag is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut_batches(whole, 2, 4 << 20):
                found = [anchors(x.as_buffer().to_pybytes(), min_chars) for x in batch.column(2).cast(pa.binary())]
                n = [len(x) for x in found]
                names = np.frombuffer(b"".join(name for x in found for _, name in x), np.int64).reshape(-1, 2)
                at = np.fromiter((at for x in found for at, _ in x), np.int32, len(names))
                own = [pa.array(np.repeat(batch.column(i).to_numpy(), n)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(at), pa.array(names[:, 0]), pa.array(names[:, 1])], ["doc", "tag", "at", "a", "b"])

    text = F.col("text").cast("string")
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    return rows.select(F.col("doc_id").cast("long").alias("doc"), _tag(text).alias("tag"), text.alias("text")).mapInArrow(run, "doc long, tag long, at int, a long, b long")


def overlaps(docs: DataFrame, min_chars: int = 20) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """(doc, tag, at, e): each anchor of a later document with its first holder e(doc, tag, at); and
    the stored tables that this reads."""
    held = stored(anchor_table(docs, min_chars), "anchors")
    met = held.groupBy("a", "b").agg(F.min(F.struct("doc", "tag", "at")).alias("e"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n"))
    shared = stored(met.where("e.doc < last").select("a", "b", "e", "n"), "shared")
    hot = F.broadcast(shared.orderBy(F.desc("n"), "a", "b").limit(HOT).select("a", "b", "e"))
    names = hot.select("a", "b")
    rare = shared.select("a", "b", "e").join(F.broadcast(names), ["a", "b"], "left_anti")
    both = held.join(hot, ["a", "b"]).unionByName(held.join(F.broadcast(names), ["a", "b"], "left_anti").join(rare.hint("merge"), ["a", "b"]))
    return both.where("e.doc < doc").select("doc", "tag", "at", "e"), (held, shared)


def aligned_blocks(matches: DataFrame) -> DataFrame:
    """(doc, tag, blocks, keep): the aligned blocks of each later document, with the earlier document, where
    the block starts in either, and its lines; keep has a boolean per line up to the last that goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("earlier", pa.int64()), ("start_earlier", pa.int32()), ("start", pa.int32()), ("lines", pa.int32())]))
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                out, masks = [], []
                for rows in batch.column(2).to_pylist():
                    pairs: dict[tuple[int, int], dict[int, int]] = {}
                    for r in rows:
                        e = r["e"]
                        pairs.setdefault((e["doc"], e["tag"]), {})[r["at"]] = e["at"]
                    found = [(key[0], *block) for key, places in pairs.items() for chain in patience([(x, y) for y, x in places.items()]) for block in blocks_of(chain)]
                    found.sort(key=lambda b: (b[2], b[0], b[1]))
                    out.append([dict(zip(("earlier", "start_earlier", "start", "lines"), b)) for b in found])
                    keep = np.ones(max(b[2] + b[3] for b in found), bool)
                    for _, _, start, n in found:
                        keep[start : start + n] = False
                    masks.append(keep)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind), pa.array(masks, pa.list_(pa.bool_()))], ["doc", "tag", "blocks", "keep"])

    met = matches.groupBy("doc", "tag").agg(F.collect_set(F.struct("at", "e")).alias("rows"))
    return met.mapInArrow(run, "doc long, tag long, blocks array<struct<earlier: long, start_earlier: int, start: int, lines: int>>, keep array<boolean>")


def dedup_lines(docs: DataFrame, min_chars: int = 20, added: tuple[str, str] = ("n_lines", "n_deleted")) -> DataFrame:
    """docs with its own columns, deleted lines taken out of `text`, and at the end the numbers of
    lines and of deleted lines, named by `added`."""
    matches, tables = overlaps(docs, min_chars)
    masks = stored(aligned_blocks(matches).select("doc", "tag", "keep"), "masks", *tables)
    text = F.col("text").cast("string")
    one, two, three = (f"_{n}_of_line_dedup" for n in ("doc", "tag", "keep"))
    masks = masks.select(F.col("doc").alias(one), F.col("tag").alias(two), F.col("keep").alias(three))
    rows = docs.join(masks.hint("merge"), (F.col("doc_id").cast("long") == F.col(one)) & (_tag(text) == F.col(two)), "left")
    lines, keep = F.split(text, "\n"), F.col(three)
    new = F.when(keep.isNull(), text).otherwise(F.array_join(F.filter(lines, lambda _, i: F.coalesce(F.get(keep, i), F.lit(True))), "\n"))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(lines))
    n_deleted = F.when(keep.isNull(), 0).otherwise(F.size(F.filter(keep, lambda k: ~k)))
    own = [new.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in added]
    return rows.select(*own, n_lines.cast("long").alias(added[0]), n_deleted.cast("long").alias(added[1]))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: its lines, those deleted, and the SHA-256 of the text that stays."""
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))

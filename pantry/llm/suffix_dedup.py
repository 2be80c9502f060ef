"""Long repeats over a run-length index (r-index).

A byte is removed if it is covered by a string of `length` bytes that also starts in a document
with a smaller doc_id. To find these strings in a corpus of any size, it is first dealt out so that
all occurrences of one string meet, and then indexed piece by piece:

1. Every string of `length` bytes is named by the least hash among its 16-byte grams. Neighbouring
   strings mostly have the same name, so a text is a sequence of runs, and a run of strings is one
   segment of a little over `length` bytes.
2. Names that occur in one document only are dropped: a shuffle of names, not of text. A task
   sends a name that several of its documents hold once, however often it occurs.
3. The segments under the names that are left are dealt out by name. Copies of a segment within a
   slice of a task are answered there; one of them is sent.
4. Segments that differ under one name go into an index, some megabytes at a time, cut to the
   strings whose hash occurs twice among them (no others can be found): suffixes are sorted, the Burrows-Wheeler transform is kept as runs with the text positions of the rows at
   both ends of each, and intervals of rows that agree in `length` bytes keep their earliest
   document. Matching statistics of each segment are streamed through it backwards: while the
   transform has the segment's next byte the row follows, otherwise it jumps to the nearest run end
   with that byte that agrees the longest. Where the match is at least `length` bytes long and its
   interval has an earlier document, the string there is marked.
5. A name with more than `most` segments does not go into one index. Its segments are cut into
   single strings, dealt out by the string, and met in sorted order, one at a time.

Hashes only decide where strings meet; whether they are equal is decided on the bytes.

Defined results for odd rows: a null text is an empty one. A row without doc_id counts as greater
than all others. Rows that share a doc_id do not remove from each other, and fare alike if their
texts are equal. An empty table gives an empty result. A text is taken whole, whatever its length; a
very long one is a slice of its own. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_batches, forget, stored, table

GRAM = 16
SEAM = 0xFF  # a byte that UTF-8 never has
LAST = 2**63 - 1
#: Strings to a segment at most; more only occur where a text repeats itself.
RUN = 64


def _words(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as a big-endian number."""
    n = len(raw) - 7
    out = np.empty(max(n, 0), np.uint64)
    data = raw.tobytes()
    for i in range(min(8, max(n, 0))):
        part = np.frombuffer(data, ">u8", (len(data) - i) // 8, i)
        out[i::8] = part[: len(out[i::8])]
    return out


def _least(values: np.ndarray, n: int) -> np.ndarray:
    width = 1
    while 2 * width <= n:
        values = np.minimum(values[: len(values) - width], values[width:])
        width *= 2
    return np.minimum(values[: len(values) - (n - width)], values[n - width :]) if width < n else values


def runs(datas: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, strings, name) of every run, in order."""
    raw = np.frombuffer(bytes([SEAM]).join(datas), np.uint8)
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, none
    eight = _words(raw)
    h = eight[:-8] * np.uint64(0x9E3779B97F4A7C15) + (eight[8:] ^ np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    name = _least(h, length - GRAM + 1)
    sizes = np.array([len(d) for d in datas], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    count = np.maximum(sizes - length + 1, 0)  # strings of each document
    at = np.arange(count.sum()) + np.repeat(starts - (np.cumsum(count) - count), count)
    doc = np.repeat(np.arange(len(datas)), count)
    name = name[at]
    new = np.concatenate(([True], (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])))[: len(at)]
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(at)))
    parts = -(-n // RUN)
    if (parts > 1).any():
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        head, n = np.repeat(head, parts) + step * RUN, np.minimum(np.repeat(n, parts) - step * RUN, RUN)
    return doc[head], at[head] - starts[doc[head]], n, name[head].view(np.int64)


class RunLengthIndex:
    """Strings with owners, in the order of their owners, as a run-compressed transform."""

    def __init__(self, strings: list[bytes], owners: np.ndarray, length: int):
        self.length = length
        seam = bytes([SEAM])
        text = np.frombuffer(seam.join(strings) + seam, np.uint8)
        sizes = np.array([len(s) + 1 for s in strings], np.int64)
        owner = np.repeat(owners, sizes)
        end = np.repeat(np.cumsum(sizes), sizes)  # just past the seam of each position's string
        n = len(text)
        here = np.arange(n)
        order, rank = self._sorted(text, end - here)
        self.words = _words(np.concatenate([text, np.full(7 + 8, SEAM, np.uint8)]))
        self.end = end
        bwt = text[order - 1]
        change = np.flatnonzero(np.concatenate(([True], bwt[1:] != bwt[:-1])))
        self.starts = change  # rows at which runs start
        self.stops = np.append(change[1:], n) - 1
        self.chars = bwt[change]
        self.first, self.last = order[self.starts], order[self.stops]  # text positions of run ends
        by_char = np.argsort(self.chars, kind="stable")
        run_sizes = self.stops - self.starts + 1
        self.to = np.empty(len(change), np.int64)  # where each run's first row goes
        self.to[by_char] = np.cumsum(run_sizes[by_char]) - run_sizes[by_char]
        self.by_char = by_char
        self.char_keys = self.chars[by_char].astype(np.int64) * len(change) + by_char  # rising
        # intervals of rows that agree in `length` bytes and their earliest owner
        whole = end - here - 1 >= length
        key = rank(length)
        sorted_key, long_enough = key[order], whole[order]
        new = np.concatenate(([True], (sorted_key[1:] != sorted_key[:-1]) | ~long_enough[1:] | ~long_enough[:-1]))
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, n))
        earliest = np.minimum.reduceat(owner[order], head)
        many = size > 1
        self.lows, self.highs, self.earliest = head[many], head[many] + size[many], earliest[many]

    @staticmethod
    def _sorted(text: np.ndarray, left: np.ndarray):
        """Suffixes up to their seams by prefix doubling, equal ones by position; and a function
        that ranks prefixes of a given length of at least 8."""
        n = len(text)
        word = _words(np.concatenate([text, np.full(7, SEAM, np.uint8)]))
        cut = np.minimum(left, 8)
        word |= np.where(cut < 8, np.uint64(2**64 - 1) >> (8 * cut.astype(np.uint64) % np.uint64(64)), np.uint64(0))  # what lies behind a seam counts as seam

        def ranked(key: np.ndarray) -> np.ndarray:
            order = np.argsort(key)
            key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
            return rank

        rank = ranked(word)
        ranks = {8: rank}
        width = 8
        longest = int(left.max(initial=0))

        def shifted(rank: np.ndarray, by: int) -> np.ndarray:
            out = np.full(n, n, np.int64)
            out[: max(n - by, 0)] = rank[by:]
            out[left <= by] = n
            return out

        while width < longest:
            rank = ranked(rank * (n + 1) + shifted(rank, width))
            width *= 2
            ranks[width] = rank

        def prefix_rank(length: int) -> np.ndarray:
            base = max(w for w in ranks if w <= length)
            return ranks[base] if base == length else ranked(ranks[base] * (n + 1) + shifted(ranks[base], length - base))

        return np.argsort(rank * n + np.arange(n)), prefix_rank

    def _agree(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Bytes, `most` at most, in which the suffixes at a and b agree."""
        most = np.minimum(most, np.minimum(self.end[a] - 1 - a, self.end[b] - 1 - b))
        out = np.zeros(len(a), np.int64)
        open_ = np.flatnonzero(most > 0)
        while len(open_):
            differ = self.words[a[open_] + out[open_]] ^ self.words[b[open_] + out[open_]]
            same = differ == 0
            rest = differ[~same]
            first = np.zeros(len(rest), np.int64)  # the first of the 8 bytes that differs
            for shift in (32, 16, 8):
                high = rest >> np.uint64(64 - shift) == 0
                first[high] += shift // 8
                rest = np.where(high, rest << np.uint64(shift), rest)
            out[open_[~same]] += first
            open_ = open_[same]
            out[open_] += 8
            open_ = open_[out[open_] < most[open_]]
        return np.minimum(out, np.maximum(most, 0))

    def statistics(self, strings: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Streams the strings backwards, side by side: for each step (which strings, position in
        them, length of the longest match from there, a row of the index that has it)."""
        sizes = np.array([len(s) for s in strings], np.int64)
        flat = np.frombuffer(b"".join(strings), np.uint8)
        base = np.cumsum(sizes) - sizes
        row = np.zeros(len(strings), np.int64)
        place = np.full(len(strings), self.first[0], np.int64)
        match = np.zeros(len(strings), np.int64)
        for t in range(int(sizes.max(initial=0))):
            who = np.flatnonzero(sizes > t)
            c = flat[base[who] + sizes[who] - 1 - t]
            run = np.searchsorted(self.starts, row[who], "right") - 1
            off = np.flatnonzero(self.chars[run] != c)
            if len(off):
                w, want = who[off], c[off].astype(np.int64)
                after = np.searchsorted(self.char_keys, want * len(self.starts) + run[off])
                up, down = self.by_char[np.maximum(after - 1, 0)], self.by_char[np.minimum(after, len(self.by_char) - 1)]
                from_up = np.where((after > 0) & (self.chars[up] == want), self._agree(place[w], self.last[up], match[w]), -1)
                from_down = np.where((after < len(self.by_char)) & (self.chars[down] == want), self._agree(place[w], self.first[down], match[w]), -1)
                higher = from_up >= from_down
                run[off] = np.where(higher, up, down)
                row[w] = np.where(higher, self.stops[up], self.starts[down])
                place[w] = np.where(higher, self.last[up], self.first[down])
                match[w] = np.maximum(from_up, from_down)  # -1: the byte is nowhere, the next match starts anew
            good = match[who] >= 0
            w, r = who[good], run[good]
            row[w] = self.to[r] + row[w] - self.starts[r]
            place[w] -= 1
            match[w] += 1
            match[who[~good]] = 0
            yield who, sizes[who] - 1 - t, match[who], row[who]

    def marks(self, strings: list[bytes], owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(string, position) of every `length` bytes of a string that an earlier owner has too."""
        which, where = [], []
        for who, at, match, row in self.statistics(strings):
            good = match >= self.length
            who, at, row = who[good], at[good], row[good]
            i = np.searchsorted(self.lows, row, "right") - 1
            ok = i >= 0
            who, at, row, i = who[ok], at[ok], row[ok], i[ok]
            ok = (row < self.highs[i]) & (self.earliest[i] < owners[who])
            which.append(who[ok])
            where.append(at[ok])
        return (np.concatenate(which), np.concatenate(where)) if which else (np.zeros(0, np.int64),) * 2


def _with_company(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, stop): each string that has `length` bytes whose hash occurs more than once,
    from the first of these to the last one's end."""
    sizes = np.array([len(s) for s in strings], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    words = _words(np.frombuffer(bytes([SEAM]).join(strings), np.uint8))
    n = len(words) - (length - 8)
    h = np.zeros(n, np.uint64)
    factor = 0x9E3779B97F4A7C15
    for at in (*range(0, length - 8, 8), length - 8):
        h += words[at : at + n] * np.uint64(factor)
        factor = (factor * factor + 0x94D049BB133111EA) % 2**64 | 1
    count = np.maximum(sizes - length + 1, 0)
    string = np.repeat(np.arange(len(strings)), count)
    at = np.arange(len(string)) - np.repeat(np.cumsum(count) - count, count)
    h = h[np.repeat(starts, count) + at]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    found = np.zeros(len(h), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    string, at = string[found], at[found]
    head = np.flatnonzero(np.concatenate(([True], string[1:] != string[:-1]))[: len(string)])
    tail = np.append(head[1:], len(string))[: len(head)] - 1
    return string[head], at[head], at[tail] + length


def _spans_of(which: np.ndarray, where: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marks as spans (string, start, end), neighbours together."""
    order = np.lexsort((where, which))
    which, where = which[order], where[order]
    head = np.concatenate(([True], (which[1:] != which[:-1]) | (where[1:] > where[:-1] + length)))[: len(which)]
    tail = np.concatenate((head[1:], [True]))[: len(which)]
    return which[head], where[head], where[tail] + length


def _heads(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1]))[: len(sorted_values)])


def _owners(segment: pa.Array, doc: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(number of each row's string, the strings, the least doc of each)."""
    coded = segment.dictionary_encode()
    code = coded.indices.to_numpy()
    owner = np.full(len(coded.dictionary), LAST)
    np.minimum.at(owner, code, doc)
    return code, coded.dictionary, owner


def judged(name: np.ndarray, segment: pa.Array, doc: np.ndarray, tag: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Rows of whole names, in order of these -> spans (doc, tag, start, end)."""
    code, strings, owner = _owners(segment, doc)
    head = _heads(name)
    several = np.minimum.reduceat(code, head) != np.maximum.reduceat(code, head)
    mixed = np.unique(code[np.repeat(several, np.diff(np.append(head, len(name))))])
    mixed = mixed[np.argsort(owner[mixed], kind="stable")]
    whose = a = b = np.zeros(0, np.int64)  # spans within strings
    if len(mixed):
        texts = strings.take(pa.array(mixed)).to_pylist()
        which, starts, stops = _with_company(texts, length)
        if len(which):
            cut = [texts[i][x:y] for i, x, y in zip(which.tolist(), starts.tolist(), stops.tolist())]
            owners = owner[mixed[which]]
            i, a, b = _spans_of(*RunLengthIndex(cut, owners, length).marks(cut, owners), length)
            whose, a, b = mixed[which[i]], a + starts[i], b + starts[i]
            order = np.argsort(whose, kind="stable")
            whose, a, b = whose[order], a[order], b[order]
    later = doc > owner[code]
    size = pc.binary_length(strings).to_numpy()[code[later]]
    count = np.bincount(whose, minlength=len(strings))
    rows = np.flatnonzero(~later & (count[code] > 0))
    n = count[code[rows]]
    each = np.repeat(rows, n)
    span = np.arange(len(each)) + np.repeat((np.cumsum(count) - count)[code[rows]] - (np.cumsum(n) - n), n)
    return (
        np.concatenate((doc[later], doc[each])), np.concatenate((tag[later], tag[each])),
        np.concatenate((start[later], start[each] + a[span])), np.concatenate((start[later] + size, start[each] + b[span])),
    )


def _text_rows(docs: DataFrame) -> DataFrame:
    """(doc, text, key); key names the text of a document, so that versions of one, or the texts without
    doc_id, are not one group. Two that shared a key would only be looked at more closely."""
    text = F.col("text").cast("string")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), text.alias("text")).where(F.octet_length("text") > 0)
    return rows.withColumn("key", F.xxhash64("doc", "text"))


def _encoded(column: pa.Array) -> list[bytes]:
    return [x.encode("utf-8", "surrogatepass") for x in column.to_pylist()]


#: What a name's row is for: to be met with others, to be passed on as shared, to be met and known as shared.
ASK, KNOWN, SURE = 0, 1, 2


def shared_names(docs: DataFrame, length: int) -> DataFrame:
    """(key, name): for every text the names that another document has as well, and perhaps some more."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut_batches(whole, 1, 2 << 20):
                who, _, _, name = runs(_encoded(batch.column(1)), length)
                doc, key = (batch.column(i).to_numpy()[who] for i in (0, 2))
                order = np.lexsort((key, doc, name))
                name, doc, key = name[order], doc[order], key[order]
                once = np.concatenate(([True], (name[1:] != name[:-1]) | (key[1:] != key[:-1])))[: len(name)]
                name, doc, key = name[once], doc[once], key[once]
                head = _heads(name)
                n = np.diff(np.append(head, len(name)))
                several = np.repeat(n > 1, n)  # texts of this slice
                low, high = (f.reduceat(doc, head) if len(head) else doc for f in (np.minimum, np.maximum))
                kind = np.where(low < high, SURE, ASK).astype(np.int8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((x[head], x[several]))) for x in (name, doc, key)] + [pa.array(np.concatenate((kind, np.full(several.sum(), KNOWN, np.int8))))],
                    ["name", "doc", "key", "kind"],
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.int8)]  # rows of the last name, while it is not known to be shared
        shared_name = None  # the last name, if it is
        for batch in batches:
            rows = [batch.column(i).to_numpy() for i in range(4)]
            known = rows[3] == KNOWN
            out_name, out_key = rows[0][known], rows[2][known]
            name, doc, key, kind = (np.concatenate((a, b[~known])) for a, b in zip(held, rows))
            if len(name):
                head = _heads(name)
                shared = (np.minimum.reduceat(doc, head) < np.maximum.reduceat(doc, head)) | (np.maximum.reduceat(kind, head) == SURE)
                if shared_name is not None:
                    shared |= name[head] == shared_name
                keep = np.repeat(shared, np.diff(np.append(head, len(name))))
                out_name, out_key = np.concatenate((out_name, name[keep])), np.concatenate((out_key, key[keep]))
                shared_name = int(name[-1]) if shared[-1] else None
                held = [x[len(x) if shared[-1] else head[-1] :] for x in (name, doc, key, kind)]
            yield pa.RecordBatch.from_arrays([pa.array(out_key), pa.array(out_name)], ["key", "name"])

    sent = _text_rows(docs).mapInArrow(emit, "name long, doc long, key long, kind byte")
    dealt = sent.repartition(F.when(F.col("kind") == KNOWN, F.xxhash64("key")).otherwise(F.col("name"))).sortWithinPartitions("name")
    return dealt.mapInArrow(meet, "key long, name long")


_SEGMENT = "name long, segment binary, doc long, tag long, start int, stop int"
_SEGMENT_TYPES = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
_SEGMENT_NAMES = ["name", "segment", "doc", "tag", "start", "stop"]


def _segments(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_SEGMENT_TYPES)], _SEGMENT_NAMES)


def _batch(name: np.ndarray, segment: pa.Array, doc: np.ndarray, tag: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(name), segment, pa.array(doc), pa.array(tag), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], _SEGMENT_NAMES)


def _once(rows: Iterator[tuple]) -> list[tuple]:
    """Of rows(name, bytes, doc, tag, start) with equal bytes those of the smallest doc stay; of the
    others the span is known, and their bytes become null."""
    rows = list(rows)
    least: dict[bytes, int] = {}
    for _, data, doc, _, _ in rows:
        least[data] = min(doc, least.get(data, doc))
    return [(name, data if doc == least[data] else None, doc, tag, start, start + len(data)) for name, data, doc, tag, start in rows]


def repeated_spans(docs: DataFrame, length: int = 50, most: int = 20_000, index_bytes: int = 1 << 20, passes: int = 2) -> DataFrame:
    """docs(doc_id, text) -> a table (doc, tag, start, stop) of byte spans to remove, which may
    overlap; doc is the doc_id, the greatest long for null, and tag is xxhash64 of the text.
    Segments take several times the room of the text that they cover, so names are dealt with in
    `passes` parts, and the shuffle of one part is gone before the next."""
    names = stored(shared_names(docs, length), "names")
    listed = names.groupBy("key").agg(F.collect_set("name").alias("names"))
    rows = _text_rows(docs).withColumn("tag", F.xxhash64("text")).join(listed, "key").select("doc", "text", "tag", "names")
    rows = stored(rows, "named", names)
    parts = [stored(_spans_of_part(rows, part, passes, length, most, index_bytes), "spans") for part in range(passes)]
    forget(rows)
    found = parts[0]
    for more in parts[1:]:
        found = found.union(more)
    spans = found.where("segment IS NULL").select("doc", "tag", "start", "stop")
    left = found.where("segment IS NOT NULL")
    return spans if left.isEmpty() else spans.union(_single_strings(left, length))


def _spans_of_part(rows: DataFrame, part: int, passes: int, length: int, most: int, index_bytes: int) -> DataFrame:
    """Spans, their segment null; and the segments of names that have too many of them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut_batches(whole, 1, 2 << 20):
                datas = _encoded(batch.column(1))
                who, start, n, name = runs(datas, length)
                lists = batch.column(3)
                wanted = np.zeros(len(who), bool)
                edges = np.searchsorted(who, np.arange(len(datas) + 1))
                for i in range(len(datas)):
                    wanted[edges[i] : edges[i + 1]] = np.isin(name[edges[i] : edges[i + 1]], lists[i].values.to_numpy())
                wanted &= name % passes == part
                who, start, n, name = (x[wanted] for x in (who, start, n, name))
                stop = start + n + length - 1
                segment = pa.array([datas[i][x:y] for i, x, y in zip(who.tolist(), start.tolist(), stop.tolist())], pa.binary())
                doc, tag = (batch.column(i).to_numpy()[who] for i in (0, 2))
                code, _, owner = _owners(segment, doc)
                first = doc == owner[code]
                yield _batch(name[first], segment.filter(pa.array(first)), doc[first], tag[first], start[first], stop[first])
                # the other copies: spans that touch become one
                name, doc, tag, start, stop, who = (x[~first] for x in (name, doc, tag, start, stop, who))
                head = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (start[1:] > stop[:-1])))[: len(who)])
                tail = np.append(head[1:], len(who))[: len(head)] - 1
                yield _batch(name[head], pa.nulls(len(head), pa.binary()), doc[head], tag[head], start[head], stop[tail])

    def judge(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        name = batch.column(0).to_numpy()
        n = np.diff(np.append(_heads(name), len(name)))
        over = np.repeat(n > most, n)
        yield batch.filter(pa.array(over))
        batch = batch.filter(pa.array(~over))
        if batch.num_rows:
            doc, tag, start = (batch.column(i).to_numpy() for i in (2, 3, 4))
            doc, tag, start, stop = judged(name[~over], batch.column(1), doc, tag, start, length)
            yield _batch(np.zeros(len(doc), np.int64), pa.nulls(len(doc), pa.binary()), doc, tag, start, stop)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # rows that are not judged yet
        over = None  # a name that has too many rows, of which more may come
        for whole in batches:
            known = whole.column(1).is_null()
            yield whole.filter(known)
            batch = whole.filter(pc.invert(known))
            if over is not None:
                same = pc.equal(batch.column(0), over)
                yield batch.filter(same)
                batch = batch.filter(pc.invert(same))
            if not batch.num_rows:
                continue
            over = None
            held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            name = held.column(0).to_numpy()
            last = int(np.searchsorted(name, name[-1]))
            done, rest = held.slice(0, last), held.slice(last)
            if rest.num_rows > most:
                yield rest
                held, over = None, int(name[-1])
            elif last and pc.sum(pc.binary_length(done.column(1))).as_py() >= index_bytes:
                held = rest
            else:
                continue
            if done.num_rows:
                yield from judge(done)
        if held is not None:
            yield from judge(held)

    sent = rows.mapInArrow(cut, _SEGMENT)
    dealt = sent.repartition(F.when(F.col("segment").isNull(), F.xxhash64("doc", "start")).otherwise(F.col("name"))).sortWithinPartitions("name")
    return dealt.mapInArrow(index, _SEGMENT)


def _single_strings(left: DataFrame, length: int) -> DataFrame:
    """The spans of segments, string by string."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                columns = [c.to_pylist() for c in batch.slice(at, 4096).columns]
                each = ((xxhash.xxh64_intdigest(data[i : i + length]) >> 1, data[i : i + length], doc, tag, a + i) for _, data, doc, tag, a, _ in zip(*columns) for i in range(len(data) - length + 1))
                yield _segments(_once(each))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, 0
        for batch in batches:
            out = []
            for _, data, doc, tag, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if data is not None and data != last:
                    last, first = data, doc
                if data is None or doc > first:
                    out.append((None, None, doc, tag, a, b))
            yield _segments(out)

    single = left.mapInArrow(strings, _SEGMENT).repartition(F.when(F.col("segment").isNull(), F.xxhash64("doc", "start")).otherwise(F.col("name")))
    rest = stored(single.sortWithinPartitions("segment", "doc").mapInArrow(meet, _SEGMENT), "spans")
    return rest.select("doc", "tag", "start", "stop")


_SPANS = "array<struct<start: int, stop: int>>"


def merged_spans(spans: DataFrame) -> DataFrame:
    """(doc, tag, spans), the spans of a text in order and without overlaps."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for many in batch.column(2).to_pylist():
                now: list[dict] = []
                for s in sorted(many, key=lambda s: s["start"]):
                    if now and s["start"] <= now[-1]["stop"]:
                        now[-1]["stop"] = max(now[-1]["stop"], s["stop"])
                    else:
                        now.append(s)
                out.append(now)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], ["doc", "tag", "spans"])

    met = spans.groupBy("doc", "tag").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    return met.mapInArrow(merge, f"doc long, tag long, spans {_SPANS}")


def remove_repeats(docs: DataFrame, length: int = 50, most: int = 20_000, index_bytes: int = 1 << 20) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, kept binary, spans), a row per row of docs; kept is null where
    nothing is removed."""
    text = F.col("text").cast("string")
    found = merged_spans(repeated_spans(docs, length, most, index_bytes))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("tag"))

    @F.pandas_udf("binary")
    def left(texts, spans):
        def cut(text, many):
            if text is None or many is None:
                return None
            data, at, out = text.encode("utf-8", "surrogatepass"), 0, []
            for s in many:
                out.append(data[at : s["start"]])
                at = s["stop"]
            return b"".join([*out, data[at:]])

        return texts.__class__([cut(a, b) for a, b in zip(texts, spans)], dtype=object)

    joined = rows.join(found, ["doc", "tag"], "left")
    return joined.select("doc_id", "text", left(F.when(F.col("spans").isNotNull(), F.col("text")), F.col("spans")).alias("kept"), "spans")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    bytes_ = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        "doc_id", bytes_.alias("n_bytes"), F.coalesce(gone, F.lit(0).cast("long")).alias("n_removed"),
        F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans")).cast("long").alias("n_spans"),
        F.sha2(F.coalesce(F.col("kept"), F.col("text").cast("binary"), F.lit(b"")), 256).alias("kept_sha256"),
    )

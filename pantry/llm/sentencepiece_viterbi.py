"""SentencePiece encoding and decoding with a shared-prefix forward pass.

A text is normalised as the model file says, spaces become marks, and the text is cut before each
run of marks: no piece of the model reaches over such a cut, so the marked words that result are
encoded by themselves. The distinct words of a slice of documents are sorted, which is a
depth-first walk through their trie, and each word takes over the forward states of the prefix
that it shares with the word before it.

For a unigram model the state at a position is the best score of a path to it and the path's last
piece (Viterbi). For a BPE model adding up scores gives wrong results, as merges are greedy; the
state is then the last piece of the encoding of the prefix, which is unique: the one piece that
ends there and whose merge order is compatible with the last piece before it (two pieces are
compatible if their concatenation is encoded as just these two). Following the last pieces back
gives exactly what merging gives, and prefixes share it as they share Viterbi's.

Characters that no piece covers become byte pieces, or the unknown id where the model has none.

Defined results for odd rows: a null text is an empty one, which has no ids. Repeated rows stay
repeated, and other columns are not looked at. Text that holds the mark itself decodes to spaces. An empty
table gives an empty result. A text is taken whole, whatever its length; a very long one is a slice of its own,
and what a worker remembers between slices is bounded in bytes.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import cached_property, lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_batches, table

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Bytes, about, of the words of one generation (two are kept) that a worker remembers; and pairs of pieces.
REMEMBERED = 24 << 20
PAIRS = 200_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + n]
            at += n


class Model:
    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        trainer, normalizer = {}, {}
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode("utf-8"))
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.types.append(own.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.squeeze = bool(normalizer.get(4, 1))
        if normalizer.get(2) or self.kind not in (UNIGRAM, BPE) or trainer.get(24, 0):
            raise ValueError("models with a character map, of another kind, or with marks at word ends are not supported")
        if any(t in (USER, UNUSED) for t in self.types):
            raise ValueError("models with user-defined or unused pieces are not supported")
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("models with pieces over several words are not supported")
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == NORMAL}
        self.longest = max(map(len, self.ids), default=1)
        self.bytes = {int(p[1:-1], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        self.unknown = next((i for i, t in enumerate(self.types) if t == UNKNOWN), 0)
        self.recent: dict[str, bytes] = {}
        self.former: dict[str, bytes] = {}
        self.held = 0
        self._pairs: dict[tuple[str, str], bool] = {}

    # text and words

    def normalised(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)

    def merged(self, text: str) -> list[str]:
        """Encoding by merging, the definition for BPE; used on single pieces and pairs of them."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    @cached_property
    def endings(self) -> dict:
        """A trie of the reversed pieces that are their own encoding, as no other can come out of
        merging; a piece stands in its last node under an empty key."""
        root: dict = {}
        for p in self.ids:
            if self.merged(p) == [p]:
                node = root
                for c in reversed(p):
                    node = node.setdefault(c, {})
                node[""] = p
        return root

    def compatible(self, a: str, b: str) -> bool:
        got = self._pairs.get((a, b))
        if got is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            got = self._pairs[a, b] = self.merged(a + b) == [a, b]
        return got

    # the forward pass

    def encode_sorted(self, words: list[str]) -> list[list[int]]:
        """words: sorted and distinct. Their ids, word by word."""
        return [self._ids(word, last) for word, last in (self._bpe_states(words) if self.kind == BPE else self._unigram_states(words))]

    def _bpe_states(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        last: list[str] = [""]  # last[i]: the last piece of the encoding of word[:i]
        before = ""
        endings, pairs = self.endings, self._pairs
        for word in words:
            del last[len(commonprefix((before, word))) + 1 :]
            for end in range(len(last), len(word) + 1):
                piece = word[end - 1]
                start, node, found = end, endings, []
                while start:
                    start -= 1
                    node = node.get(word[start])
                    if node is None:
                        break
                    if "" in node:
                        found.append((start, node[""]))
                for start, one in reversed(found):
                    if start == 0:
                        piece = one
                        break
                    ok = pairs.get((last[start], one))
                    if self.compatible(last[start], one) if ok is None else ok:
                        piece = one
                        break
                last.append(piece)
            before = word
            yield word, last

    def _unigram_states(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        last, best = [""], [0.0]
        before = ""
        floor = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0
        for word in words:
            keep = len(commonprefix((before, word))) + 1
            del last[keep:], best[keep:]
            for end in range(len(last), len(word) + 1):
                top, piece = -float("inf"), word[end - 1]
                for start in range(max(0, end - self.longest), end):
                    k = self.ids.get(word[start:end])
                    score = best[start] + (self.scores[k] if k is not None else floor if start == end - 1 else -float("inf"))
                    if score > top:
                        top, piece = score, word[start:end]
                last.append(piece)
                best.append(top)
            before = word
            yield word, last

    def _ids(self, word: str, last: list[str]) -> list[int]:
        out: list[int] = []
        end = len(word)
        while end:
            piece = last[end]
            k = self.ids.get(piece)
            if k is not None:
                out.append(k)
            elif self.bytes:
                out.extend(self.bytes[b] for b in reversed(piece.encode("utf-8", "surrogatepass")))
            else:
                out.append(self.unknown)
            end -= len(piece)
        out.reverse()
        return out

    # whole texts

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Words of earlier calls are remembered for a while: those of two generations, of which the
        former goes when the recent one is full."""
        cut = [_WORDS.findall(self.normalised(t or "")) for t in texts]
        words = set().union(*cut)
        if self.held > REMEMBERED:
            self.recent, self.former, self.held = {}, self.recent, 0
        memory, former = self.recent, self.former
        new = []
        for word in words:
            if word not in memory:
                if word in former:
                    memory[word] = former[word]
                    self.held += 4 * len(word) + len(former[word]) + 200
                else:
                    new.append(word)
        new.sort()
        for word, ids in zip(new, self.encode_sorted(new)):
            memory[word] = own = np.array(ids, np.int32).tobytes()
            self.held += 4 * len(word) + len(own) + 200
        return [np.frombuffer(b"".join([memory[w] for w in words]), np.int32) for words in cut]

    @cached_property
    def _spelled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all pieces end to end, where each starts, and how long it is."""
        spelled = []
        for p, t in zip(self.pieces, self.types):
            if t == BYTE:
                spelled.append(bytes([int(p[1:-1], 16)]))
            else:
                spelled.append(b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(MARK, " ").encode())
        sizes = np.array([len(x) for x in spelled], np.int64)
        return np.frombuffer(b"".join(spelled), np.uint8), np.cumsum(sizes) - sizes, sizes

    def decode(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        flat, starts, sizes = self._spelled
        n = sizes[ids]
        ends = np.cumsum(n)
        text = flat[np.arange(ends[-1]) + np.repeat(starts[ids] - (ends - n), n)].tobytes().decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def _model(data: bytes) -> Model:
    """One model, with what it remembers, for all tasks of a worker."""
    return Model(data)


def load_model(path: str = MODEL_FILE) -> bytes:
    """The model file, read on the driver; a vocabulary's size does not grow with the data."""
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, ids, n_tokens, round_trip), a row per row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(load_model(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for whole in batches:
            for batch in cut_batches(whole, 1, 2 << 20):
                texts = batch.column(1).to_pylist()
                ids = model.encode(texts)
                same = [model.decode(x) == (t or "") for x, t in zip(ids, texts)]
                sizes = np.array([len(x) for x in ids], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(sizes), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_tokens", "round_trip"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean")


def decode_documents(encoded: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """encoded(doc_id, ids) -> (doc_id, text); null ids decode to an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_model(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for batch in batches:
            texts = [model.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")



def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: number of ids, the ids' SHA-256 (of their text, joined by commas), and whether they decode to the text."""
    found = encode_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_tokens", F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), "round_trip")

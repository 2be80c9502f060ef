"""What the sequence model sees of each token: a set of `key:value` and `key` strings.

Attributes of tokens are built-in expressions; Python puts the sets of a sentence together, for each
token its own, and those of up to three tokens on either side. A token has about a hundred features, so sentences are
taken a few at a time, however many a batch brings.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import structure as S
from . import tokens as T

FLAGS = {"is_capitalised": T.is_capitalised, "is_unit": T.is_unit, "is_punc": T.is_punctuation, "is_ambiguous": T.is_ambiguous_unit, "is_dimension": T.is_dimension}
#: How many tokens' features are held at once, besides those of one sentence.
PIECE = 2048
SIDES = (("prev_", -1), ("prev2_", -2), ("prev3_", -3), ("next_", 1), ("next2_", 2), ("next3_", 3))


def inside_brackets(feats: list[str]) -> list[bool]:
    """The k-th opening bracket goes with the k-th closing one, of whatever kind."""
    opened = [i for i, x in enumerate(feats) if x in ("(", "[")]
    closed = [i for i, x in enumerate(feats) if x in (")", "]")]
    depth = [0] * (len(feats) + 1)
    for a, b in zip(opened, closed):
        if a < b:
            depth[a] += 1
            depth[b] -= 1
    out, now = [], 0
    for i, x in enumerate(feats):
        now += depth[i]
        out.append(now > 0 or x in ("(", ")", "[", "]"))
    return out


def _after(feats: list[str], mark: str) -> list[bool]:
    first = feats.index(mark) if mark in feats else len(feats)
    return [i > first for i in range(len(feats))]


@lru_cache(maxsize=16_384)
def _prefixed(name: str, marks: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(name + x for x in marks)


def _by_token(words, feats, tags, stems, shapes, flags, length) -> Iterator[list[str]]:
    n = len(words)
    common: list[list[str]] = [[k for k in FLAGS if flags[k][i]] + [f"word_shape:{shapes[i]}"] for i in range(n)]
    marks = {"is_in_parens": inside_brackets(feats), "is_after_comma": _after(feats, ","), "is_after_plus": _after(feats, "plus")}
    marks["is_length_unit"] = [(i > 0 and feats[i - 1] == "!num") if x == "in" else x.lower() in S.C.LENGTH_UNITS for i, x in enumerate(feats)]
    spans = {"example_phrase": S.examples(words, tags), "dimensional_phrase": S.dimensions(words, tags)}
    either = S.alternatives(words, tags)
    spans["mip_start"] = [(a, a + 1) for a, _ in either]
    spans["mip_end"] = [(b - 1, b) for _, b in either]
    within = {k: {i for a, b in v for i in range(a, b)} for k, v in spans.items()}
    marks |= {k: [i in v for i in range(n)] for k, v in within.items()}
    first = min(S.sentence_starts(words, feats, tags), default=n)
    marks["after_sentence_split"] = [i >= first for i in range(n)]
    for k, v in marks.items():
        for i in range(n):
            if v[i]:
                common[i].append(k)
    shared = [tuple(x) for x in common]
    for i in range(n):
        own = ["bias:", f"sentence_length:{length}", f"pos:{tags[i]}", f"stem:{stems[i]}", *common[i]]
        if feats[i] != stems[i]:
            own.append(f"token:{feats[i]}")
        if feats[i] != "!num":
            for k in (3, 4, 5):
                if len(feats[i]) > k:
                    own += [f"prefix_{k}:{feats[i][:k]}", f"suffix_{k}:{feats[i][-k:]}"]
        for name, step in SIDES:
            j = i + step
            if 0 <= j < n:
                a, b = min(i, j), max(i, j)
                own += [f"{name}stem:{stems[j]}", f"{name}pos_ngram:{'+'.join(tags[a : b + 1])}", f"{name}pos:{tags[j]}", *_prefixed(name, shared[j])]
        yield own


def _parts(tokens: Column | str, tags: Column | str, stems: Column | str | None) -> Column:
    """What Python needs of a sentence."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    words = column(tokens)
    feats = F.transform(words, T.feature_text)
    parts = {
        "words": F.transform(words, lambda t: F.coalesce(T.singular(t), t)), "feats": feats, "tags": column(tags),
        "stems": feats if stems is None else column(stems), "shapes": F.transform(feats, T.word_shape), "length": T.length_bucket(words),
    }
    parts |= {k: F.transform(feats, f) for k, f in FLAGS.items()}
    return F.struct(*[c.alias(k) for k, c in parts.items()])


def _pieces(sentences: pa.StructArray) -> Iterator[pa.StructArray]:
    sizes = pc.fill_null(pc.list_value_length(sentences.field("words")), 0).to_numpy(zero_copy_only=False)
    at = np.cumsum(sizes + 1) // PIECE
    edges = (np.flatnonzero(np.diff(at)) + 1).tolist()
    for a, b in zip([0, *edges], [*edges, len(sentences)]):
        if b > a:
            yield sentences.slice(a, b - a)


def _read(piece: pa.StructArray) -> Iterator[Iterator[list[str]] | None]:
    """The features of each sentence's tokens, made as they are asked for."""
    columns = {f.name: c.to_pandas() for f, c in zip(piece.type, piece.flatten())}
    for i in range(len(piece)):
        row = {k: c.iloc[i] for k, c in columns.items()}
        if row["words"] is None or row["tags"] is None or row["stems"] is None:
            yield None
            continue
        row = {k: v if k == "length" else v.tolist() for k, v in row.items()}
        length = int(row["length"]) if len(row["words"]) else 0
        yield _by_token(*(row[k] for k in ("words", "feats", "tags", "stems", "shapes")), {k: row[k] for k in FLAGS}, length)


def sentence_features(tokens: Column | str, tags: Column | str, stems: Column | str | None = None) -> Column:
    """array<array<string>>: the features of each token. `stems` are the stems of the tokens' feature
    texts; without them these texts stand for their stems. Null tokens or tags give null."""
    kind = pa.list_(pa.list_(pa.string()))

    @F.arrow_udf("array<array<string>>")
    def build(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for piece in _pieces(batch):
                yield pa.array([None if x is None else list(x) for x in _read(piece)], kind)

    return build(_parts(tokens, tags, stems))


def feature_kinds(df: DataFrame, tokens: Column | str, tags: Column | str, stems: Column | str | None = None) -> DataFrame:
    """(feature, n): how often each kind of feature, which is what stands before its first colon, is one of a token's
    in df. Features are counted as they are made, a token at a time; only counts leave Python."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for piece in _pieces(batch.column(0)):
                for sentence in _read(piece):
                    for own in sentence or ():
                        found.update([x.partition(":")[0] for x in own])
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["feature", "n"])

    counts = df.select(_parts(tokens, tags, stems).alias("sentence")).mapInArrow(count, "feature string, n long")
    return counts.groupBy("feature").agg(F.sum("n").alias("n"))

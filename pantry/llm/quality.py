"""A quality classifier by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled text. A text is cut
into pieces, each piece is compressed with either dictionary, and the difference of the two sums
over their total says which kind of text it resembles. Pieces start fresh, so a long text is held
against the dictionaries all the way and not against its own beginning; the whole text is read. A
logistic curve, fitted on labelled rows that neither dictionary has seen, turns the difference
into a probability.

Learning takes at most `max_rows` labelled rows of each class for each of the two purposes, chosen by
a hash of doc_id; those are the bounds of the sample. Rows whose crc32(doc_id as text) mod 5 is 0 are
never learned from. Of the rest, remainder 4 fits the curve and 1 to 3 train the dictionaries. Texts are
taken whole: the curve is fitted on differences that executors take over whole texts, so only a number
a row reaches the driver; the texts for the dictionaries are cut into pieces all along, and of these a
class gives `max_pieces`, chosen by a hash of doc_id and place, as a dictionary is trained in one process.
Nothing but the text enters a score.

Defined results for odd rows: a null text counts as empty, and an empty text has difference zero.
A row without a doc_id is scored, is not held out, and teaches nothing. A doc_id with labels that
contradict each other teaches nothing. Of rows that share a doc_id the one whose text has the least
hash teaches, whatever the order of rows; all are scored. Where a class has no labelled text, every difference is
zero and the score is the share of good rows among those that were learned from (1 if none). An empty
table gives an empty result. Texts are scored whole, one at a time. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, stored, table

PIECE = 2048
TRAIN_PIECE = 1024


@dataclass(frozen=True)
class Model:
    good: bytes | None
    bad: bytes | None
    slope: float
    offset: float
    level: int = 3

    def compressors(self):
        return [
            zstandard.ZstdCompressor(
                level=self.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False
            )
            for d in (self.bad, self.good)
        ]

    def differences(self, texts) -> np.ndarray:
        """Above zero: the text is closer to the good dictionary."""
        out = np.zeros(len(texts))
        if self.good is None or self.bad is None:
            return out
        bad, good = self.compressors()
        for i, text in enumerate(texts):
            data = text.encode("utf-8", "replace") if isinstance(text, str) else b""
            pieces = [data[a : a + PIECE] for a in range(0, len(data), PIECE)]
            b = sum(len(bad.compress(p)) for p in pieces)
            g = sum(len(good.compress(p)) for p in pieces)
            out[i] = (b - g) / (b + g) if pieces else 0.0
        return out

    def scores(self, texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.differences(texts) + self.offset, -40, 40)))


def _dictionary(pieces: list[bytes], size: int) -> bytes | None:
    if not pieces:
        return None
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves
        return b"".join(pieces)[-size:]


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Logistic regression on one feature by Newton steps; x is scaled for the ridge."""
    scale = x.std() or 1.0
    design = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        grad = design.T @ (p - y) + ridge * len(x) * w * [1, 0]
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.diag([ridge * len(x) + 1e-9, 1e-9])
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, quality, rest, text): the rows to learn from, 4 * max_rows at most, a text each; and the
    whole pool (doc_id, quality, rest) that they are taken from."""
    pool = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("high"))
        .where("quality = high").drop("high").withColumn("rest", remainder(F.col("doc_id"))).where("rest <> 0")
    )
    order = F.xxhash64(F.lit("quality"), "doc_id")
    parts = [pool.where(f"quality = {q} AND {use}").orderBy(order, "doc_id").limit(max_rows) for q in (0, 1) for use in ("rest < 4", "rest = 4")]
    chosen = parts[0].union(parts[1]).union(parts[2]).union(parts[3])  # 4 * max_rows ids at most
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(F.xxhash64(text).alias("hash"), text.alias("text")).alias("t"))
    rows = rows.where("doc_id IS NOT NULL AND t.text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "quality", "rest").agg(F.min("t").alias("t")).select("doc_id", "quality", "rest", "t.text"), pool


def pieces_of(rows: DataFrame, max_pieces: int) -> dict[int, list[bytes]]:
    """By class, pieces of the rows(doc_id, quality, text), `max_pieces` at most, in the order of their hash."""

    @F.pandas_udf("array<binary>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [d[a : a + TRAIN_PIECE] for d in [t.encode("utf-8", "replace")] for a in range(0, len(d), TRAIN_PIECE)])

    each = rows.select("doc_id", "quality", F.posexplode(cut("text")).alias("place", "piece"))
    order = F.xxhash64(F.lit("pieces"), "doc_id", "place")
    return {q: [bytes(r.piece) for r in each.where(f"quality = {q}").orderBy(order, "doc_id", "place").limit(max_pieces).collect()] for q in (0, 1)}


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 1500, max_pieces: int = 6000, dictionary_bytes: int = 65_536) -> Model:
    """docs(doc_id, text), labels(doc_id, quality)."""
    rows, pool = labelled(docs, labels, max_rows)
    rows = stored(rows, "labelled")
    pieces = pieces_of(rows.where("rest < 4"), max_pieces)
    model = Model(_dictionary(pieces[1], dictionary_bytes), _dictionary(pieces[0], dictionary_bytes), 0.0, 0.0)

    @F.pandas_udf("double")
    def difference(texts: pd.Series) -> pd.Series:
        return pd.Series(model.differences(texts.tolist()))

    fit = rows.where("rest = 4").select("doc_id", "quality", difference("text").alias("x")).collect() if model.good and model.bad else []
    fit.sort(key=lambda r: r.doc_id)
    if len({r.quality for r in fit}) < 2:
        kinds = [r.quality for r in rows.select("quality").collect()]
        share = min(max(float(np.mean(kinds)) if kinds else 1.0, 1e-6), 1 - 1e-6)
        forget(rows)
        return Model(model.good, model.bad, 0.0, float(np.log(share / (1 - share))))
    forget(rows)
    y = np.array([r.quality for r in fit], float)
    slope, offset = _curve(np.array([r.x for r in fit]), y)
    # classes are weighted to their shares in the whole pool, as the sample takes as many of either
    shares = {r.quality: r["n"] for r in pool.where("rest = 4").groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(shares) == 2:  # from the sample's odds to the pool's
        offset += float(np.log(shares[1] / shares[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return Model(model.good, model.bad, slope, offset, model.level)


def score_column(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts.tolist()))

    return score(text.cast("string"))


def classify(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, held_out, score, predicted)."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        score_column(model, F.col("text")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    return docs.where(score_column(model, F.col("text")) >= threshold)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, learn(docs, table(spark, sf_dir, "labels")))

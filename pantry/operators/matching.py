"""Matching names to foods: token and description weights, sentence vectors, soft distance, and the
decision between rankings.

Rankings are tables (query, doc, score, rank) as `retrieval.ranked` makes them, at most TOP rows a query;
in `bm25` greater scores are better, in the distances `semantic` and `fuzzy` smaller ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import retrieval as R

# Fixed values.
NEGATIONS = ("no", "not", "without", "NS")
LESSENING = ("with", "on")
AGREEMENT = 0.25  # overlap of rankings below which the soft distance is asked as well
SURE, NEAR = 0.95, 0.01  # below the first, two scores that differ by a share of up to the second are no decision
SEMANTIC = 0.275
PREFERENCE = ("survey_fndds_food", "sr_legacy_food", "foundation_food")  # rising


def without_leading(tokens: Column, words: Sequence[str]) -> Column:
    """Tokens from the first on that is none of `words`; all of them where there is no other."""
    kept = F.filter(F.transform(tokens, lambda t, i: F.when(~F.lower(t).isin(*words), i)), lambda i: i.isNotNull())
    first = F.get(kept, F.lit(0))
    return F.when(first.isNull(), tokens).otherwise(F.slice(tokens, first + 1, F.greatest(F.size(tokens) - first, F.lit(0))))


def with_raw(tokens: Column, stems: Sequence[str]) -> Column:
    """`raw` is added unless a stem tells that the food is not."""
    return F.when(F.arrays_overlap(tokens, F.array(*[F.lit(s) for s in stems])), tokens).otherwise(F.concat(tokens, F.array(F.lit("raw"))))


def description_weights(phrases: Column) -> Column:
    """array<array<double>>: weights of a description's tokens by phrase. A phrase counts a thousandth
    less than the one before; from a negation on a token counts nothing, from `with` or `on` half less."""

    def from_on(phrase: Column, words: Sequence[str], i: Column) -> Column:
        at = [F.array_position(phrase, w) for w in words]
        return sum((F.when((p > 0) & (p <= i + 1), 1).otherwise(0) for p in at), F.lit(0))

    def one(phrase: Column, k: Column) -> Column:
        base = 1 - 0.001 * k
        return F.transform(phrase, lambda _, i: F.when(from_on(phrase, NEGATIONS, i) > 0, F.lit(0.0)).otherwise(F.greatest(base - 0.5 * from_on(phrase, LESSENING, i), F.lit(0.0))))

    return F.transform(phrases, one)


def tag_factor(tag: Column) -> Column:
    """Nouns count more, verbs less."""
    return F.when(F.startswith(tag, F.lit("NN")), 1.2).when(F.startswith(tag, F.lit("JJ")), 1.05).when(F.startswith(tag, F.lit("VB")), 0.7).otherwise(1.0)


def sentence_vector(vectors: Column, weights: Column, empty: float, size: int) -> Column:
    """The mean of weighted token vectors after each dimension has been scaled to length 1 across the
    tokens; a dimension that is zero in all tokens stays zero, no tokens give a vector of `empty`."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for v, w in batches:
            out = []
            for rows, by in zip(v, w):
                if rows is None or by is None:
                    out.append(None)
                elif not len(rows):
                    out.append(np.full(size, empty, np.float32))
                else:
                    m = np.stack([np.asarray(r, np.float32) for r in rows])
                    norm = np.sqrt((m * m).sum(axis=0))
                    scaled = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
                    out.append((scaled * np.asarray(by, np.float32)[:, None]).mean(axis=0))
            yield pd.Series(out, dtype=object)

    return run(vectors, weights)


def soft_distance(left: dict[str, np.ndarray], right: dict[str, np.ndarray]) -> float:
    """1 - soft Jaccard of two token sets: a token belongs to a set by 1 if it is in it, else by its
    greatest likeness 1 / (1 + exp(-1 / distance)) to a token there. Two empty sets are at 1."""
    if not left or not right:
        return 1.0

    def belongs(token: str, vector: np.ndarray, to: dict[str, np.ndarray]) -> float:
        if token in to:
            return 1.0
        d = np.sqrt(((np.stack(list(to.values())) - vector) ** 2).sum(axis=1)).min()
        return 1.0 if d == 0 else float(1 / (1 + np.exp(-1 / d)))

    every = {**left, **right}
    a = np.array([belongs(t, v, left) for t, v in every.items()])
    b = np.array([belongs(t, v, right) for t, v in every.items()])
    shared = float((a * b).sum())
    return 1 - shared / (float(a.sum() + b.sum()) - shared)


def soft_distances(left: Column, right: Column) -> Column:
    """soft_distance of two array<struct<token, vector>>; null gives null."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        sets = lambda rows: {r["token"]: np.asarray(r["vector"], np.float64) for r in rows}
        return pd.Series([None if x is None or y is None else soft_distance(sets(x), sets(y)) for x, y in zip(a, b)], dtype="Float64")

    return run(left, right)


def ranker_confidence(scores: Column) -> Column:
    """How clearly a ranking has a winner: 0.7 * the gap to the next other score + 0.3 / (1 + variation of
    the scores below the top); fewer than two scores: 0."""
    a = F.sort_array(scores, asc=False)
    top, n = F.get(a, F.lit(0)), F.size(a)
    second = F.coalesce(F.get(F.filter(a, lambda x: x != top), F.lit(0)), F.lit(0.0))
    rest = F.slice(a, F.lit(2), F.greatest(n - 1, F.lit(0)))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    mean = total(rest) / F.nullif(n - 1, F.lit(0))
    spread = F.sqrt(total(F.transform(rest, lambda x: (x - mean) * (x - mean))) / F.nullif(n - 1, F.lit(0)))
    even = F.when((n > 2) & (mean > 0), 1 / (1 + spread / mean)).otherwise(F.lit(1.0))
    return F.when((n < 2) | (top == 0), F.lit(0.0)).otherwise(0.7 * (top - second) / F.nullif(top, F.lit(0.0)) + 0.3 * even)


def _weighed(ranking: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(query, doc, name) normalised, and (query, name_confidence)."""
    scaled = R.normalised_scores(ranking.where(F.col("rank") <= R.TOP)).select("query", "doc", F.col("normalised").alias(name))
    return scaled, scaled.groupBy("query").agg(ranker_confidence(F.collect_list(name)).alias(f"{name}_confidence"))


def fused(bm25: DataFrame, semantic: DataFrame, fuzzy: DataFrame) -> DataFrame:
    """(query, doc, score): documents of the first two rankings, by normalised scores (distances turned
    round) weighted with each ranking's confidence; a third of the sum, to six places. Where no ranking
    has any confidence the score is null."""
    (a, of_a), (b, of_b), (c, of_c) = (_weighed(r, n) for r, n in ((bm25, "a"), (semantic, "b"), (fuzzy, "c")))
    rows = a.join(b, ["query", "doc"], "full_outer").join(c, ["query", "doc"], "left")
    for of in (of_a, of_b, of_c):
        rows = rows.join(of, "query", "left")
    trust = {n: F.coalesce(f"{n}_confidence", F.lit(0.0)) for n in "abc"}
    total = F.nullif(sum(trust.values(), F.lit(0.0)), F.lit(0.0))
    good = {"a": F.coalesce("a", F.lit(0.0)), "b": 1 - F.coalesce("b", F.lit(1.0)), "c": 1 - F.coalesce("c", F.lit(1.0))}
    return rows.select("query", "doc", F.round(sum((trust[n] / total * good[n] for n in "abc"), F.lit(0.0)), 6).alias("score"))


def agreed(bm25: DataFrame, semantic: DataFrame) -> DataFrame:
    """(query, doc): queries for which the best of both rankings, ties included, is one document."""
    tops = []
    for ranking, best in ((bm25, F.max), (semantic, F.min)):
        top = best("score").over(Window.partitionBy("query"))
        tops.append(ranking.withColumn("_top", top).where(F.col("score") == F.col("_top")).groupBy("query").agg(F.min("doc").alias("low"), F.max("doc").alias("high")))
    one = tops[0].alias("x").join(tops[1].alias("y"), "query").where("x.low = x.high AND y.low = y.high AND x.low = y.low")
    return one.select("query", F.col("x.low").alias("doc"))


def unclear(bm25: DataFrame, semantic: DataFrame) -> DataFrame:
    """(query): those whose rankings overlap too little, for which `fuzzy` is wanted as well."""
    return R.rank_biased_overlap(bm25, semantic).where(F.col("overlap") < AGREEMENT).select("query")


def matched(bm25: DataFrame, semantic: DataFrame, fuzzy: DataFrame, docs: DataFrame) -> DataFrame:
    """(query, doc, confidence): at most one document a query; docs(doc, dataset). Rankings that agree
    decide at once with confidence 1. Else the best fused score does, ties by dataset and smaller doc,
    unless the second is too near, more documents tie than there are datasets, there is no second, or the
    best one's distance is too great."""
    sure = agreed(bm25, semantic)
    scores = fused(bm25, semantic, fuzzy).join(sure, "query", "left_anti").where(F.col("score").isNotNull())
    liking = sum((F.when(F.col("dataset") == d, i).otherwise(0) for i, d in enumerate(PREFERENCE, 1)), F.lit(0))
    rows = scores.join(docs.select("doc", "dataset"), "doc", "left")
    by = Window.partitionBy("query")
    order = by.orderBy(F.desc("score"), liking.desc(), F.asc("doc"))
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("second", F.lead("score").over(order)).withColumn("best", F.max("score").over(by))
    rows = rows.withColumn("ties", F.sum((F.col("score") == F.col("best")).cast("int")).over(by)).where("place = 1 AND second IS NOT NULL")
    apart = F.when(F.col("score") == F.col("second"), 0.0).otherwise((F.col("score") - F.col("second")) / F.nullif(F.col("score"), F.lit(0.0)))
    rows = rows.where(~((F.col("score") < SURE) & (apart > 0) & (apart <= NEAR)) & ~((apart == 0) & (F.col("ties") > len(PREFERENCE))))
    for name, ranking in (("b", semantic), ("c", fuzzy)):
        rows = rows.join(ranking.select("query", "doc", F.col("score").alias(name)), ["query", "doc"], "left")
    close = rows.where(F.least(F.coalesce("b", F.lit(1.0)), F.coalesce("c", F.lit(1.0))) <= SEMANTIC)
    return sure.withColumn("confidence", F.lit(1.0)).union(close.select("query", "doc", F.col("score").alias("confidence")))

"""The sequence model: integer weights, best labels by Viterbi, marginals by forward and backward sums.

A model of up to BROADCAST_WEIGHTS weights is broadcast, and a sentence's scores, labels and marginals
are one pass over its features, without a shuffle. Of a larger one, scores of tokens are a join and an
exact integer sum that Spark combines before its shuffle. Results are the same.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A bound on what is broadcast; a weight takes some tens of bytes.
BROADCAST_WEIGHTS = 2_000_000
BEGIN, INSIDE, SEPARATOR = "B_NAME_TOK", "I_NAME_TOK", "NAME_SEP"


@dataclass(frozen=True)
class Model:
    """`weights`(kind emission or transition, feature or label before, label, weight); the order of
    `labels` breaks ties. A weight stands for (weight - zero) / scale."""

    weights: DataFrame
    labels: tuple[str, ...]
    scale: float = 1.0
    zero: float = 0.0

    def emissions(self) -> DataFrame:
        w = self.weights.where("kind = 'emission'").groupBy("feature")
        one = lambda label: F.coalesce(F.sum(F.when(F.col("label") == label, F.col("weight"))), F.lit(0))
        return w.agg(F.array(*[one(x) for x in self.labels]).alias("w"))

    def table(self) -> tuple[dict[str, int], np.ndarray] | None:
        """The row of each feature in a matrix of weights by label; None where there are too many."""
        rows = self.weights.where("kind = 'emission'").select("feature", "label", "weight").limit(BROADCAST_WEIGHTS + 1).collect()
        if len(rows) > BROADCAST_WEIGHTS:
            return None
        at, of = {x: i for i, x in enumerate(self.labels)}, {}
        for r in rows:
            of.setdefault(r.feature, len(of))
        out = np.zeros((len(of) + 1, len(at)), np.int64)  # the last row: nothing known
        for r in rows:
            if r.label in at:
                out[of[r.feature], at[r.label]] += r.weight
        return of, out

    def transitions(self) -> np.ndarray:
        at = {x: i for i, x in enumerate(self.labels)}
        out = np.zeros((len(at), len(at)), np.int64)
        for r in self.weights.where("kind = 'transition'").collect():  # labels x labels rows
            if r.feature not in at or r.label not in at:
                raise ValueError(f"a transition names an unknown label: {r.feature}, {r.label}")
            out[at[r.feature], at[r.label]] = r.weight
        return out


def state_scores(df: DataFrame, keys: list[str], features: str, model: Model, out: str = "scores") -> DataFrame:
    """(keys, out): for each token, in order, the sum of its features' weights by label. A feature
    counts once a token, unknown ones nothing. Rows with null or no tokens have no row here."""
    each = df.select(*keys, F.posexplode(features).alias("_at", "_set")).select(*keys, "_at", F.explode_outer(F.array_distinct("_set")).alias("feature"))
    joined = each.join(model.emissions(), "feature", "left")
    sums = [F.coalesce(F.sum(F.col("w")[i]), F.lit(0)).cast("long") for i in range(len(model.labels))]
    token = joined.groupBy(*keys, "_at").agg(F.array(*sums).alias("_s"))
    return token.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_at", "_s"))).alias("_rows")).select(*keys, F.col("_rows._s").alias(out))


def viterbi(scores: np.ndarray, moves: np.ndarray, names: tuple[int, int, int] | None) -> list[int]:
    """The best path; of equal ones the lowest label before. `names`: places of the first, further and
    separating name labels; a further one then needs a first one since the start or the last separator
    on its path. With the first name label at place 0 only the start is held to that."""
    n, width = scores.shape
    best = scores[0].astype(float)
    opened = np.zeros(width, bool)
    if names:
        begin, inside, separator = names
        best[inside] = -np.inf
        opened[begin] = True
    back = np.zeros((n, width), np.int64)
    for t in range(1, n):
        reach = best[:, None] + moves + scores[t]
        if names and begin:
            reach[~opened, inside] = -np.inf
        back[t] = reach.argmax(axis=0)
        best = reach[back[t], np.arange(width)]
        if names and begin:
            opened = opened[back[t]]
            opened[begin], opened[separator] = True, False
    path = [int(best.argmax())]
    for t in range(n - 1, 0, -1):
        path.append(int(back[t, path[-1]]))
    return path[::-1]


def marginals(scores: np.ndarray, moves: np.ndarray, scale: float, zero: float) -> np.ndarray:
    """Probabilities of labels by position, of weights taken back to single precision."""
    real = lambda x: (x.astype(np.float32) - np.float32(zero)) / np.float32(scale)
    state, step = real(scores), real(moves)
    n = len(state)
    forward, backward = np.zeros(state.shape), np.zeros(state.shape)
    forward[0] = state[0]
    for t in range(1, n):
        forward[t] = np.logaddexp.reduce(forward[t - 1][:, None] + step, axis=0) + state[t]
    for t in range(n - 2, -1, -1):
        backward[t] = np.logaddexp.reduce(((step + state[t + 1]).astype(float) + backward[t + 1]).T, axis=0)
    return np.exp(forward + backward - np.logaddexp.reduce(forward[-1]))


LABELLED = "array<struct<label:string,score:double>>"
# Labels of names, the first of equal ones first.
NAME_LABELS = ("B_NAME_TOK", "I_NAME_TOK", "NAME_VAR", "NAME_MOD", "NAME_SEP")


def guessed(found: list[str], p: np.ndarray, labels: list[str], least: float = 0.2) -> list[str]:
    """Labels with a name where there is none: of the runs of tokens that have a name label with a
    probability above `least`, the first of the longest gets each token's likeliest one."""
    ours = [x for x in NAME_LABELS if x in labels]
    if not ours or any("NAME" in x for x in found):
        return found
    of_names = p[:, [labels.index(x) for x in ours]]
    runs: list[list[int]] = [[]]
    for t in range(len(found)):
        if of_names[t].max() > least:
            runs[-1].append(t)
        elif runs[-1]:
            runs.append([])
    run = max(runs, key=len)
    return [ours[int(of_names[t].argmax())] if t in run else x for t, x in enumerate(found)]


def label(df: DataFrame, keys: list[str], features: str, model: Model, constrained: bool = True, out: str = "labelled", guess: float | None = None) -> DataFrame:
    """df with `out`, array<struct<label, score>>: each token's label on the best path and its marginal
    probability. Null or no tokens give null. `keys` name a row. With `guess`, sentences without a name get
    one as `guessed` has it."""
    labels = list(model.labels)
    if constrained and not {BEGIN, INSIDE, SEPARATOR} <= set(labels):
        raise ValueError(f"the constraint needs the labels {BEGIN}, {INSIDE} and {SEPARATOR}")
    if model.weights.isEmpty():
        raise ValueError("the model has no weights")
    names = tuple(labels.index(x) for x in (BEGIN, INSIDE, SEPARATOR)) if constrained else None
    moves, scale, zero = model.transitions(), model.scale, model.zero

    def decoded(m: np.ndarray) -> list[dict]:
        p = marginals(m, moves, scale, zero)
        best = [labels[j] for j in viterbi(m, moves, names)]
        if guess is not None:
            best = guessed(best, p, labels, guess)
        return [{"label": x, "score": float(p[t, labels.index(x)])} for t, x in enumerate(best)]

    known = model.table()
    if known is None:

        @F.pandas_udf(LABELLED)
        def decode(sentences: pd.Series) -> pd.Series:
            return pd.Series([decoded(np.stack(list(rows))) for rows in sentences], dtype=object)

        found = state_scores(df, keys, features, model, "_scores").select(*keys, decode("_scores").alias(out))
        return df.join(found, keys, "left")
    shared = df.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf(LABELLED)
    def score(sentences: pd.Series) -> pd.Series:
        of, weights = shared.value
        none = len(weights) - 1
        result: list[list[dict] | None] = []
        for tokens in sentences:
            if tokens is None or not len(tokens):
                result.append(None)
                continue
            sets = [[of.get(f, none) for f in set(t)] if t is not None and len(t) else [none] for t in tokens]
            starts = np.cumsum([0, *map(len, sets[:-1])])
            result.append(decoded(np.add.reduceat(weights[[i for s in sets for i in s]], starts)))
        return pd.Series(result, dtype=object)

    return df.withColumn(out, score(features))


def accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: share of sentences and of tokens whose labels are the true ones; both are arrays of
    strings, and a sentence of other length is wrong as a whole and in all its true tokens."""
    same = F.size(truth) == F.size(predicted)
    right = F.when(same, F.size(F.filter(F.arrays_zip(F.col(truth).alias("a"), F.col(predicted).alias("b")), lambda p: p["a"] == p["b"]))).otherwise(0)
    n = F.when(F.col(truth).isNotNull(), F.size(truth)).otherwise(0)
    rows = df.select(n.alias("n"), F.coalesce(right, F.lit(0)).alias("k"))
    return rows.agg(F.avg((F.col("k") == F.col("n")).cast("double")).alias("sentence"), (F.sum("k") / F.sum("n")).alias("token"))

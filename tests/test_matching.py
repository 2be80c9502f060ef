import numpy as np
import pytest
from pyspark.sql import functions as F

from pantry.operators import matching as M

RANKING = "query int, doc int, score double, rank int"


def test_tokens(spark):
    df = spark.createDataFrame([(["hot", "Cool", "milk", "hot"],), (["hot"],), ([],), (None,)], "t array<string>")
    assert [r.x for r in df.select(M.without_leading(F.col("t"), ["hot", "cool"]).alias("x")).collect()] == [["milk", "hot"], ["hot"], [], None]
    assert [r.x for r in df.limit(2).select(M.with_raw(F.col("t"), ["milk"]).alias("x")).collect()] == [["hot", "Cool", "milk", "hot"], ["hot", "raw"]]
    tags = spark.createDataFrame([("NNS",), ("JJ",), ("VBD",), ("CD",)], "t string").select(M.tag_factor(F.col("t")).alias("x"))
    assert [r.x for r in tags.collect()] == [1.2, 1.05, 0.7, 1.0]


def test_description_weights(spark):
    df = spark.createDataFrame([([["beef", "with", "salt", "on"], ["no", "fat"], ["raw"]],)], "p array<array<string>>")
    (got,) = df.select(M.description_weights(F.col("p")).alias("x")).first()
    assert got[0] == [1.0, 0.5, 0.5, 0.0] and got[1] == [0.0, 0.0] and got[2] == [pytest.approx(0.998)]


def test_vectors(spark):
    df = spark.createDataFrame([([[3.0, 0.0], [4.0, 0.0]], [1.0, 0.5]), ([], []), (None, None)], "v array<array<float>>, w array<double>")
    got = [r.x for r in df.select(M.sentence_vector(F.col("v"), F.col("w"), 0.25, 2).alias("x")).collect()]
    assert got[0] == [pytest.approx((0.6 + 0.4) / 2), 0.0] and got[1] == [0.25, 0.25] and got[2] is None
    a, b = {"x": np.array([0.0]), "y": np.array([1.0])}, {"x": np.array([0.0])}
    near = 1 / (1 + np.exp(-1.0))
    assert M.soft_distance(a, a) == 0 and M.soft_distance(a, {}) == 1 and M.soft_distance(a, b) == pytest.approx(1 - (1 + near) / (2 + 1 + near - (1 + near)))


def test_confidence(spark):
    rows = [([1.0, 0.5, 0.0],), ([1.0, 1.0],), ([1.0],), ([],), ([0.5, 0.5, 0.5],)]
    got = [r.x for r in spark.createDataFrame(rows, "s array<double>").select(M.ranker_confidence(F.col("s")).alias("x")).collect()]
    assert got == [pytest.approx(0.7 * 0.5 + 0.3 / 2), pytest.approx(1.0), 0.0, 0.0, pytest.approx(1.0)]


def test_matched(spark):
    bm25 = [(1, 10, 9.0, 1), (1, 11, 5.0, 2), (2, 10, 9.0, 1), (2, 11, 8.0, 2), (2, 12, 1.0, 3), (3, 10, 3.0, 1), (4, 10, 3.0, 1), (4, 11, 1.0, 2)]
    near = [(1, 10, 0.1, 1), (1, 11, 0.5, 2), (2, 11, 0.1, 1), (2, 10, 0.11, 2), (2, 12, 0.9, 3), (4, 11, 0.5, 1), (4, 10, 0.6, 2)]
    a, b = (spark.createDataFrame(x, RANKING) for x in (bm25, near))
    none = spark.createDataFrame([], RANKING)
    docs = spark.createDataFrame([(10, "sr_legacy_food"), (11, "foundation_food"), (12, "survey_fndds_food")], "doc int, dataset string")
    got = {r.query: (r.doc, r.confidence) for r in M.matched(a, b, none, docs).collect()}
    assert got[1] == (10, 1.0) and got[2][0] in (10, 11) and 3 not in got and 4 not in got
    every = {(r.query, r.doc): r.score for r in M.fused(a, b, none).collect()}
    assert every[(1, 10)] == pytest.approx(1.0) and every[(1, 11)] == 0.0
    assert M.matched(none, none, none, docs).count() == 0 and {r.query for r in M.unclear(a, b).collect()} <= {1, 2, 3, 4}

import json
import math

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry
from pantry.operators import retrieval as R
from pantry.operators import sequences as S
from pantry.sources import readers as X


def test_rank_biased_overlap(spark):
    a = spark.createDataFrame([(1, d, r) for r, d in enumerate("abc", 1)] + [(2, "a", 1)], "query int, doc string, rank int")
    b = spark.createDataFrame([(1, d, r) for r, d in enumerate("bax", 1)] + [(3, "z", 1)], "query int, doc string, rank int")
    got = {r["query"]: r.overlap for r in R.rank_biased_overlap(a, b, depth=3).collect()}
    want = 0.05 * sum(0.95 ** (d - 1) * len(set("abc"[:d]) & set("bax"[:d])) / d for d in (1, 2, 3))
    assert math.isclose(got[1], want) and got[2] == got[3] == 0


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, [])], "doc int, tokens array<string>")
    q = spark.createDataFrame([(7, ["a", "a", "z"])], "q int, tokens array<string>")
    [row] = R.bm25(docs, q, "doc", "q").collect()
    assert row.doc == 1 and math.isclose(row.score, 2 * math.log(2) * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 2)))


def test_only_documents_that_share_a_noun(spark):
    docs = spark.createDataFrame([(1, ["fig", "jam"]), (2, ["jam"]), (3, []), (4, None), (5, ["fig", "fig"])], "id int, nouns array<string>")
    asked = spark.createDataFrame([("a", ["fig", "pie"]), ("b", None), ("c", ["jam", "fig"])], "name string, nouns array<string>")
    scores = spark.createDataFrame([(q, d, float(d)) for q in "abc" for d in range(1, 6)], "query string, doc int, score double")
    kept = R.sharing(scores, docs, asked, "id", "name")
    assert sorted((r.query, r.doc) for r in kept.collect()) == [("a", 1), ("a", 5), ("c", 1), ("c", 2), ("c", 5)]
    assert {(r.query, r.doc): r["rank"] for r in R.ranked(kept).collect()}[("c", 1)] == 3


def test_fusion_and_islands(spark):
    a = spark.createDataFrame([(1, "x", 3.0), (1, "y", 1.0)], "query int, doc string, score double")
    b = spark.createDataFrame([(1, "y", 5.0)], "query int, doc string, score double")
    assert {r.doc: r.score for r in R.fused(a, b).collect()} == {"x": 0.5, "y": 0.25}
    rows = spark.createDataFrame([(1, p) for p in (1, 2, 3, 7, 8, 11)], "k int, p int")
    assert sorted((r["first"], r["last"], r.n) for r in S.islands(rows, ["k"], "p").collect()) == [(1, 3, 3), (7, 8, 2), (11, 11, 1)]


def test_readers(spark, tmp_path):
    (tmp_path / "v.txt").write_text("2 3\na 1 2 3\nb 4 5 6.5\n")
    assert {r.token: list(r.vec) for r in X.word_vectors(spark, str(tmp_path / "v.txt")).collect()} == {"a": [1, 2, 3], "b": [4, 5, 6.5]}
    (tmp_path / "r.txt").write_text("NN CD CURRENT-WORD-IS-NUMBER\nVB NN PREV-WORD-IS the\n")
    assert [r.parameter for r in X.tag_rules(spark, str(tmp_path / "r.txt")).collect()] == [None, "the"]
    (tmp_path / "m.json").write_text(json.dumps({"state_features": {"a|b|X": 3}, "transitions": {"X|Y": -2}}))
    assert {tuple(r) for r in X.model(spark, str(tmp_path / "m.json")).collect()} == {("emission", "a|b", "X", 3), ("transition", "X", "Y", -2)}
    (tmp_path / "f.csv").write_text('fdc_id,data_type,description,category,more\n1,sr,"a ""b""\nc",d,\n')
    assert [tuple(r) for r in X.foods(spark, str(tmp_path / "f.csv")).collect()] == [(1, "sr", 'a "b"\nc', "d")]
    (tmp_path / "p.json").write_text(json.dumps({"cake": {"style": "x", "lines": ["1 egg", "2 cups"]}}))
    assert [tuple(r) for r in X.recipes(spark, str(tmp_path / "p.json")).collect()] == [("cake", "x", 0, "1 egg"), ("cake", "x", 1, "2 cups")]


def test_entry_points(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["token", "n"]


def test_best_of_bm25_needs_no_row_for_each_pair_and_equals_sql(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(3)
    some = lambda n: " ".join(f"w{min(int(x), 60)}" for x in r.zipf(1.3, n))
    docs = [(i, some(int(r.integers(1, 40)))) for i in range(400)] + [(500 + i, "all w1 w2") for i in range(30)]
    docs += [(3, some(9)), (3, ""), (None, "w1 w7"), (None, "w9"), (900, ""), (901, None), (902, "?")]
    docs = [(i, t if t is None else t + " each") for i, t in docs if t != "?"]
    items = [(i, some(12) + " Each each") for i in range(15)] + [(20, ""), (21, None), (22, "absent"), (23, "each"), (4, some(3))]
    pq.write_table(pa.table({"doc_id": [x[0] for x in docs], "text": [x[1] for x in docs]}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": [x[0] for x in items], "text": [x[1] for x in items]}), tmp_path / "benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = sorted(con.sql(entry.oracle_sql()["q_bm25"]).fetchall())
    for block, held in ((R.BLOCK, R.HELD), (50, 64)):
        monkeypatch.setattr(R, "BLOCK", block)
        monkeypatch.setattr(R, "HELD", held)
        found = entry.queries()["q_bm25"](spark, str(tmp_path))
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(x) for x in found.collect()) == want


def test_best_of_bm25_over_nothing(spark):
    docs = spark.createDataFrame([("a", ["x", "y"]), ("b", []), ("c", None)], "doc string, tokens array<string>")
    q = spark.createDataFrame([("k", ["y", "y"]), (None, ["x"])], "q string, tokens array<string>")
    assert {(r.query, r.doc, r.score) for r in R.bm25_top(docs, q, "doc", "q", 3).collect()} == {("k", "a", 0.0), (None, "a", 0.0)}
    assert R.bm25_top(docs.limit(0), q, "doc", "q").count() == 0 and R.bm25_top(docs, q.limit(0), "doc", "q").count() == 0

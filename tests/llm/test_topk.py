import numpy as np

from pantry.llm import topk as T


def run(spark, rows, **parameters):
    from pyspark.sql import functions as F

    from pantry.llm.common import stored

    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    v = stored(T.quantised(df), "v")
    q = stored(v.where("vec_id % 50 = 0").select(F.monotonically_increasing_id().alias("query_row"), F.col("vec_id").alias("query_id"), "v"), "q")
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in T.top_k(q, v, **parameters).collect())


def brute(rows, k=5):
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, u in good:
        if a % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(u, w)), b) for b, w in good if b != a and len(u) == len(w))[:k]
            out += [(a, n + 1, b, -s) for n, (s, b) in enumerate(best)]
    return sorted(out)


def fixture():
    rng = np.random.default_rng(0)
    rows = [(i, (rng.integers(-3, 4, 20) / 8).tolist()) for i in range(160)]
    rows += [(200 + i, rows[3][1]) for i in range(9)] + [(250, rows[3][1])]
    rows += [(300, None), (350, [1.0, None]), (400, [float("nan")]), (450, [float("inf")]), (None, rows[0][1]), (500, [1.0, 2.0]), (501, [3.0, -1.0]), (550, []), (551, [])]
    return rows


def test_against_brute_force(spark):
    rows = fixture()
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, query_rows=2, block_rows=37) == brute(rows)
    assert run(spark, []) == []


def test_huge_components_are_exact():
    q = np.array([[2**40, -(2**40) + 1]])
    v = np.array([[2**40, 2**40], [2**40, 2**40 - 1], [2**62, -(2**62)]])
    got = list(T.search_block(q, np.array([9]), v, np.array([1, 2, 3]), 2))
    assert got == [[(2, 2**63 - 1), (1, 2**40 * 2**40 - (2**40 - 1) ** 2)]]


def test_pruning_keeps_ties():
    rng = np.random.default_rng(1)
    v = rng.integers(-2, 3, (500, 64))
    q = rng.integers(-2, 3, (20, 64))
    ids = np.arange(500)[::-1].copy()
    for i, got in enumerate(T.search_block(q, np.full(20, -1), v, ids, 5, dims=4)):
        want = sorted(range(500), key=lambda j: (-int(q[i] @ v[j]), ids[j]))[:5]
        assert [g[0] for g in got] == want


def test_huge_components_against_brute_force():
    rng = np.random.default_rng(5)
    v = rng.integers(-(2**29), 2**29, (300, 40))
    v[150:200] = v[0]
    v[200:, 0] += rng.integers(0, 2, 100)
    q, ids = v[[0, 7, 250]], np.arange(300)[::-1].copy()
    for own, got in zip(q, T.search_block(q, np.full(3, -1), v, ids, 5)):
        scores = [sum(int(a) * int(b) for a, b in zip(own, w)) for w in v]
        want = sorted(range(300), key=lambda j: (-scores[j], ids[j]))[:5]
        assert got == [(j, max(-(2**63), min(2**63 - 1, scores[j]))) for j in want]

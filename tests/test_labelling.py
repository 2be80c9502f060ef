import itertools
import math

import numpy as np

from pantry.functions import tagging
from pantry.operators import labelling as L

LABELS = ("QTY", "B_NAME_TOK", "I_NAME_TOK", "NAME_SEP")


def allowed(path):
    opened = False
    for label in path:
        if label == 2 and not opened:
            return False
        opened = (opened or label == 1) and label != 3
    return True


def test_paths_and_marginals_by_brute_force():
    draw = np.random.default_rng(5)
    for _ in range(40):
        scores, moves = draw.integers(-9, 9, (4, 3)), draw.integers(-9, 9, (3, 3))
        paths = list(itertools.product(range(3), repeat=4))
        total = lambda p: sum(scores[t, j] for t, j in enumerate(p)) + sum(moves[a, b] for a, b in itertools.pairwise(p))
        assert total(L.viterbi(scores, moves, None)) == max(map(total, paths))
        weight = {p: math.exp((total(p) - 7 * 3) / 4) for p in paths}
        want = np.array([[sum(w for p, w in weight.items() if p[t] == j) for j in range(3)] for t in range(4)]) / sum(weight.values())
        assert np.allclose(L.marginals(scores, moves, 4.0, 0.0), want, atol=1e-5)


def test_constraint_holds_on_every_path():
    draw = np.random.default_rng(6)
    for _ in range(60):
        assert allowed(L.viterbi(draw.integers(-9, 9, (7, 4)), draw.integers(-9, 9, (4, 4)), (1, 2, 3)))


def test_labels_of_rows(spark):
    rows = [("emission", "num", "QTY", 5), ("emission", "a|b", "B_NAME_TOK", 5), ("emission", "c", "I_NAME_TOK", 4), ("transition", "QTY", "B_NAME_TOK", 1)]
    model = L.Model(spark.createDataFrame(rows, "kind string, feature string, label string, weight long"), LABELS, 2.0, 0.0)
    data = [(1, [["num", "num", "zzz"], ["a|b"], ["c"]]), (2, []), (3, None), (4, [["c"]]), (5, [[]])]
    df = spark.createDataFrame(data, "k int, f array<array<string>>")
    got = {r.k: r.labelled and [x.label for x in r.labelled] for r in L.label(df, ["k"], "f", model).collect()}
    assert got == {1: ["QTY", "B_NAME_TOK", "I_NAME_TOK"], 2: None, 3: None, 4: ["QTY"], 5: ["QTY"]}
    assert [tuple(r._s) for r in L.state_scores(df.where("k = 1"), ["k"], "f", model, "s").selectExpr("explode(s) AS _s").collect()][0] == (5, 0, 0, 0)


def test_accuracy(spark):
    df = spark.createDataFrame([(["A", "B"], ["A", "B"]), (["A", "B"], ["A", "A"]), (["A"], ["A", "B"])], "t array<string>, p array<string>")
    [row] = L.accuracy(df, "t", "p").collect()
    assert math.isclose(row.sentence, 1 / 3) and math.isclose(row.token, 3 / 5)


def test_tags(spark):
    lexicon = spark.createDataFrame([("the", "DT"), ("run", "VB"), ("Salt", "NNX")], "word string, tag string")
    data = [(1, ["The", "run", "Salt", "salt", "2", "in", "Butter"]), (2, []), (3, None), (4, ["would", "boil", "slowly", "chopped", "0x", "www.ab", "or", "eggs", "in"])]
    df = spark.createDataFrame(data, "k int, t array<string>")
    got = {r.k: r.tags for r in tagging.tag(df, ["k"], "t", lexicon).collect()}
    assert got[1] == ["DT", "NN", "NNX", "NN", "CD", "NN", "NNP"] and got[2] == [] and got[3] is None
    assert got[4] == ["NN", "VB", "RB", "VBN", "CD", "URL", "CC", "NNS", "NN"]


def test_rules_see_final_tags_before_and_given_tags_after(spark):
    rules = [("A", "B", "NEXT-TAG", "A"), ("A", "C", "PREV-TAG", "B")]
    [row] = spark.createDataFrame([(["x", "y", "z"], ["A", "A", "A"])], "t array<string>, g array<string>").select(tagging.apply_rules("t", "g", rules).alias("o")).collect()
    assert row.o == ["B", "B", "C"]


def test_broadcast_and_join_agree(spark, monkeypatch):
    import bench
    from pantry.functions import tagging
    from pantry.operators import parsing

    rows = [(i, t) for i, t in enumerate(["2 cups Sugar, chopped", "1 small Onion (½ cup) to taste", "", None, "12 oz word3 word4 word5"])]
    df = spark.createDataFrame(rows, "k int, s string")
    run = lambda: [tuple(r) for r in parsing.tag_sentences(df, ["k"], "s", *bench.toy_model(spark)).select("k", "tokens", "tags", "labelled").orderBy("k").collect()]
    fast = run()
    monkeypatch.setattr(L, "BROADCAST_WEIGHTS", 5)
    monkeypatch.setattr(tagging, "BROADCAST_WORDS", 1)
    slow = run()
    assert [r[:3] for r in fast] == [r[:3] for r in slow]
    for a, b in zip(fast, slow):
        assert [x.label for x in a[3] or ()] == [x.label for x in b[3] or ()] and all(abs(x.score - y.score) < 1e-9 for x, y in zip(a[3] or (), b[3] or ()))
    assert fast[3][1:] == (None, None, None) and fast[0][3][0].label == "QTY"

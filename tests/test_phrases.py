from fractions import Fraction

import pytest

from pantry.functions import phrases as P
from pantry.functions import units as U


def test_runs_and_patterns():
    assert P.runs([0, 1, 2, 4, 5]) == [[0, 1, 2], [4, 5]] and P.runs([]) == []
    labels = ["QTY", "UNIT", "PUNC", "QTY", "UNIT", "QTY", "UNIT"]
    assert P.matches(labels, ["QTY", "UNIT"]) == [[0, 1], [3, 4], [5, 6]]
    assert P.matches(labels, ["UNIT", "QTY"]) == [[1, 3], [4, 5]]
    assert P.matches(labels, ["UNIT", "QTY"], skip_others=False) == [[4, 5]]
    assert P.matches(labels, []) == P.matches([], ["A"]) == []


def test_texts():
    words = [",", "(", "a", ")", "]", "#1$2", "/", "b", "("]
    assert P.trimmed(range(9), words) == [1, 2, 3, 5, 6, 7]
    assert P.trimmed([0], words) == [0] and P.trimmed([4], words) == []
    assert P.tidy("( a ) , b / c .") == "(a), b/c."
    assert P.distinct_neighbours(["a", "a", "b", ""]) == [1, 2]
    assert [P.shown(x) for x in ("#1$2", "1#1$2", "a#b")] == ["1/2", "1 1/2", "a#b"]
    assert P.number("1#1$2") == Fraction(3, 2) and P.number("2.5") == Fraction(5, 2) and P.number("x") is None and P.number("#1$0") is None


def test_names():
    assert P.names(["B_NAME_TOK", "I_NAME_TOK", "NAME_SEP", "B_NAME_TOK"]) == [[0, 1], [3]]
    assert P.names(["NAME_VAR", "NAME_SEP", "NAME_VAR", "B_NAME_TOK"]) == [[0, 3], [2, 3]]
    assert P.names(["NAME_MOD", "B_NAME_TOK", "NAME_SEP", "B_NAME_TOK"]) == [[0, 1], [0, 3]]
    assert P.names(["NAME_VAR"]) == [[0]] and P.names(["NAME_MOD"]) == [] and P.names([]) == []


def test_columns(spark):
    words, labels = ["2", "chicken", "or", "beef", "stock", ",", "hot"], ["QTY", "NAME_VAR", "NAME_SEP", "NAME_VAR", "B_NAME_TOK", "PUNC", "PREP"]
    df = spark.createDataFrame([(1, words, labels, [0.5] * 7), (2, None, None, None), (3, [], [], [])], "k int, w array<string>, l array<string>, s array<double>")
    got = {r.k: r for r in df.select("k", P.name_phrases("w", "l", "s").alias("n"), P.phrase("w", "l", "s", "PREP").alias("p"), P.phrase("w", "l", "s", "SIZE").alias("z")).collect()}
    assert [(x.text, x.confidence, x.first) for x in got[1].n] == [("chicken stock", 0.5, 1), ("beef stock", 0.5, 3)]
    assert got[1].p.text == "hot" and got[1].p.first == 6 and got[1].z is None
    assert got[2].n is None and got[2].p is None and got[3].n == [] and got[3].p is None


def test_units(spark):
    data = [(1.0, "cup", "ml"), (2.0, "lb", "oz"), (1.0, "inch", "cm"), (1.0, "cup", "inch"), (1.0, "zzz", "g"), (None, "g", "kg"), (1.0, "l", "g"), (500.0, "g", "l")]
    df = spark.createDataFrame(data, "v double, a string, b string")
    got = [r.x for r in df.select(U.convert("v", "a", "b").alias("x")).collect()]
    assert got == [pytest.approx(236.5882365), pytest.approx(32), pytest.approx(2.54), None, None, None, pytest.approx(1000), pytest.approx(0.5)]
    assert df.limit(1).select(U.convert("v", "a", "b", "metric").alias("x")).first().x == pytest.approx(250)
    kinds = spark.createDataFrame([("imperial_cup",), ("cup",), ("",), ("Gram",), ("pinch",), ("jp_cup",), (None,)], "u string").select(U.unit_system("u").alias("s"))
    assert [r.s for r in kinds.collect()] == ["imperial", "us_customary", "none", "metric", "other", "japanese", None]

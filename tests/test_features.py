import re

import pyarrow as pa
from pyspark.sql import functions as F

from pantry.functions import features, structure
from pantry.functions import tokens as T


def test_patterns():
    assert structure._compiled("<NN.*|JJ>+").pattern == "(?:<(?:NN[^<>]*|JJ)>)+"
    assert structure._compiled(r"<\(><A>").fullmatch("<(><A>")
    slow = re.compile("((?:<(?:N|J)>)+(?:<,>)?)*(?:<C>)?(?:<(?:N|J)>)*(?:<N>)")
    fast = re.compile("((?:<(?:N|J)>)(?:<,>)?)*(?:<C>)?(?:<(?:N|J)>)*(?:<N>)")
    import itertools

    for tags in itertools.product("NJ,CX", repeat=6):
        text = "".join(f"<{t}>" for t in tags)
        assert [m.span() for m in slow.finditer(text)] == [m.span() for m in fast.finditer(text)]


def test_phrases():
    words, tags = "2 tbsp olive , vegetable or sunflower oil".split(), "CD NN NN , NN CC NN NN".split()
    assert structure.alternatives(words, tags) == [(2, 8)]
    assert structure.alternatives("cup or salt".split(), "NN CC NN".split()) == []
    assert structure.alternatives("tbsp cup".split() + ["or", "cup"], "NN NN CC NN".split()) == []
    assert structure.alternatives("salt and pepper".split(), "NN CC NN".split()) == []
    assert structure.sentence_starts("1 cup milk or 2 cup cream".split(), "!num cup milk or !num cup cream".split(), "CD NN NN CC CD NN NN".split()) == [3]
    assert structure.examples("oil such as olive oil".split(), "NN JJ IN NN NN".split()) == [(1, 5)]
    assert structure.examples("soft like butter".split(), "JJ IN NN".split()) == [(1, 3)]
    assert structure.dimensions("1 inch / 2 cm thick".split(), "CD NN SYM CD NN NN".split()) == [(0, 6)]
    assert structure.chunk([], structure.EXAMPLES) == [] and structure.chunk(["JJ"] * 60, structure.EXAMPLES) == []


def test_brackets():
    assert features.inside_brackets(list("a(b[c)d]e")) == [False, True, True, True, True, True, True, True, False]
    assert features.inside_brackets(list(")a(")) == [True, False, True]


def test_features(spark):
    data = [(1, ["2", "Cups", "milk", ",", "warm"], ["CD", "NNS", "NN", ",", "JJ"]), (2, [], []), (3, None, None)]
    df = spark.createDataFrame(data, "k int, t array<string>, p array<string>")
    got = {r.k: r.f for r in df.select("k", features.sentence_features("t", "p").alias("f")).collect()}
    assert got[2] == [] and got[3] is None
    assert set(got[1][0]) == {
        "bias:", "sentence_length:4", "pos:CD", "stem:!num", "word_shape:!xxx", "next_stem:Cup", "next_pos_ngram:CD+NNS", "next_pos:NNS", "next_is_capitalised",
        "next_is_unit", "next_word_shape:Xxx", "next2_stem:milk", "next2_pos_ngram:CD+NNS+NN", "next2_pos:NN", "next2_word_shape:xxxx",
        "next3_stem:,", "next3_pos_ngram:CD+NNS+NN+,", "next3_pos:,", "next3_is_punc", "next3_word_shape:,",
    }
    assert {"is_after_comma", "prefix_3:war", "suffix_3:arm", "prev_is_punc", "prev3_is_unit"} <= set(got[1][4])
    assert len(set(got[1][4])) == len(got[1][4])


def test_pieces_bound_what_is_held(spark):
    sentence = {"words": ["a"] * 100}
    rows = [sentence] * 300 + [{"words": None}, {"words": []}, {"words": ["a"] * 9000}, sentence]
    cut = list(features._pieces(pa.array(rows, pa.struct([("words", pa.list_(pa.string()))]))))
    assert [x for piece in cut for x in piece.to_pylist()] == rows
    held = [sorted(len(x["words"] or ()) for x in piece.to_pylist()) for piece in cut]
    assert max(sum(x[:-1]) for x in held) <= features.PIECE


def test_kinds_are_counted_as_the_features_are(spark):
    data = [(["2", "Cups", "milk", ",", "warm", "(", "or", "cream", ")"], ["CD", "NNS", "NN", ",", "JJ", "(", "CC", "NN", ")"])] * 700 + [([], []), (None, None), ([":", "x:y"], ["NN", "NN"])]
    df = spark.createDataFrame(data, "t array<string>, p array<string>").coalesce(1)
    each = df.select(F.explode(F.flatten(features.sentence_features("t", "p"))).alias("f"))
    want = each.groupBy(F.substring_index("f", ":", 1)).count().collect()
    got = features.feature_kinds(df, "t", "p").collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in want} and len(got) > 40

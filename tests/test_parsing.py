import pytest
from pyspark.sql import functions as F

from pantry.functions import amounts as A
from pantry.functions import phrases as P
from pantry.functions import stems
from pantry.functions import units as U
from pantry.operators import labelling, parsing

LETTERS = {"Q": "QTY", "U": "UNIT", "N": "B_NAME_TOK", "I": "I_NAME_TOK", "C": "COMMENT", "P": "PUNC", "R": "PREP", "V": "NAME_VAR", "-": "NAME_SEP", "F": "PURPOSE", "S": "SIZE"}


def said(text, letters, plural=(), tags=None, score=0.5):
    words = text.split()
    assert len(words) == len(letters)
    return [A.Token(w, LETTERS[x], score, i, i in plural, (tags or {}).get(i, "NN")) for i, (w, x) in enumerate(zip(words, letters))]


def parsed(*args, options=parsing.ParseOptions(), **kw):
    return parsing.parsed(said(*args, **kw), options, options.units())


def texts(found):
    return [a["text"] for a in found["amounts"]]


def test_porter():
    pairs = {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop",
        "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "rational": "ration", "hopefulness": "hope",
        "adjustment": "adjust", "adoption": "adopt", "controll": "control", "rate": "rate", "as": "as", "GS": "GS", "gas": "ga", "onions": "onion",
        "tablespoon": "tablespoon", "chopped": "chop", "finely": "fine", "!num": "!num", "sugar": "sugar", "": "",
    }
    assert {w: stems.porter(w) for w in pairs} == pairs


def test_english():
    pairs = {
        "generously": "generous", "skies": "sky", "ties": "tie", "cries": "cri", "gas": "gas", "gaps": "gap", "kiwis": "kiwi", "hopping": "hop",
        "hoped": "hope", "luxuriating": "luxuri", "by": "by", "say": "say", "cry": "cri", "coriander": "coriand", "courgette": "courgett", "microwaved": "microwav",
        "innings": "inning", "proceeding": "proceed", "national": "nation", "knightly": "knight", "consignment": "consign", "communication": "communic",
        "rolled": "roll", "youth": "youth", "owed": "owe", "puré": "puré", "Atlas": "atlas", "": "",
    }
    assert {w: stems.english(w) for w in pairs} == pairs


def test_stem_columns(spark):
    df = spark.createDataFrame([(["Onions", None],), ([],), (None,)], "t array<string>")
    assert [r.s for r in df.select(stems.porter_stems("t").alias("s")).collect()] == [["onion", None], [], None]
    assert df.select(stems.english_stems("t").alias("s")).first().s == ["onion", None]


def test_numbers():
    row = A.in_digits(said("one and one-half cup or two", "QQQUCQ"))
    assert [(t.word, t.index) for t in row] == [("1#1$2", 0), ("cup", 3), ("or", 4), ("2", 5)]
    assert [t.word for t in A.in_digits(said("One or 12", "QQQ"))] == ["1-12"]
    assert [t.word for t in A.in_digits(said("one 15", "QQ"))] == ["1", "15"]


def test_single_amounts():
    found = parsed("about #1$2 cup sugar", "CQUN")
    (amount,) = found["amounts"]
    part = amount["parts"][0]
    assert (amount["text"], part["quantity"], part["value"], part["unit"], part["approximate"], part["unit_system"]) == ("1/2 cups", "1/2", 0.5, "cup", True, "us_customary")
    assert found["comment"] is None  # `about` is part of the amount
    assert texts(parsed("2 dozen egg", "QQN")) == ["2 dozen"] and texts(parsed("dozen egg 2", "QNQ")) == ["dozen", "2"]
    assert texts(parsed("clove garlic", "UN")) == ["1 clove"] and texts(parsed("clove garlic", "UN", plural={0})) == ["cloves"]
    assert texts(parsed("some clove garlic", "CUN")) == ["clove"]
    assert [p["singular"] for a in parsed("2x 100 g bar", "QQUN")["amounts"] for p in a["parts"]] == [False, True]
    ranged = parsed("1-2 cup or so each milk", "QUCCCN")["amounts"][0]["parts"][0]
    assert (ranged["quantity"], ranged["quantity_max"], ranged["range"], ranged["approximate"], ranged["singular"]) == ("1", "2", True, True, True)
    made = parsed("pulp to yield about 2 cup", "NCCCQU")["amounts"][0]["parts"][0]
    assert made["prepared"] and made["approximate"]
    assert parsed("1e9999999 g x", "QUN")["amounts"][0]["parts"][0]["value"] is None and parsed("#1$0 g", "QU")["amounts"][0]["parts"][0]["quantity"] == "#1$0"


def test_amounts_of_several_parts():
    found = parsed("2 15 ounce can tomato", "QQUUN")
    assert texts(found) == ["2 cans", "15 ounces"] and [a["parts"][0]["singular"] for a in found["amounts"]] == [False, True]
    assert texts(parsed("15 ounce can tomato", "QUUN")) == ["1 can", "15 ounces"]
    (both,) = parsed("1 lb 2 oz beef", "QUQUN")["amounts"]
    assert (both["text"], both["joined_by"], len(both["parts"])) == ("1 lb 2 oz", "", 2)
    (less,) = parsed("1 cup less 1 tbsp milk", "QUCQUN")["amounts"]
    assert (less["text"], less["subtractive"]) == ("1 cup minus 1 tbsp", True)
    assert texts(parsed("1 cup , 1 tbsp milk", "QUPQUN")) == ["1 cup", "1 tbsp"]


def test_names_and_texts():
    assert [n["text"] for n in parsed("fresh or dry basil", "V-VN")["names"]] == ["fresh basil", "dry basil"]
    assert [n["text"] for n in parsed("large and egg", "N-N", tags={0: "JJ"})["names"]] == ["large egg"]
    (same,) = parsed("oil or oil", "N-N")["names"]
    assert (same["text"], same["confidence"], same["first"]) == ("oil", 0.5, 0)
    found = parsed("2 cup onion , chopped , the", "QUNPRPC")
    assert (found["preparation"]["text"], found["comment"], found["amounts"][0]["text"]) == ("chopped", None, "2 cups")
    kept = parsed("2 cup onion , the", "QUNPC", options=parsing.ParseOptions(discard_isolated_stop_words=False))
    assert kept["comment"]["text"] == "the"
    one = parsing.ParseOptions(separate_names=False)
    assert [n["text"] for n in parsed("oil or butter", "N-N", options=one)["names"]] == ["oil or butter"]
    assert parsed("chopped 2 onion", "RQN")["amounts"][0]["parts"][0]["prepared"] is False
    assert parsed("2 chopped onion", "QRN")["amounts"][0]["parts"][0]["prepared"] is True
    assert P.rendered([0, 1, 3], ["a", "b", "c", "d"], [0.0, 1.0, 0.0, 1.0]) == ("a b, d", 0.75, 0)


def test_corrections():
    fixed = parsing.ParseOptions(corrected=True)
    assert texts(parsed("1 teaspoon ( tsp ) salt", "QUPUPN")) == ["1 teaspoon tsp"]
    assert texts(parsed("1 teaspoon ( tsp ) salt", "QUPUPN", options=fixed)) == ["1 teaspoon"]
    assert parsed("For the sauce", "NII", options=fixed)["purpose"]["text"] == "For the sauce" and parsed("For the sauce", "NII")["purpose"] is None
    assert parsed("flat-leaf parsley", "NI")["names"][0]["text"] == "flat-leaves parsley" and parsed("flat-leaf parsley", "NI", options=fixed)["names"][0]["text"] == "flat-leaf parsley"
    with pytest.raises(ValueError):
        parsing.ParseOptions(volumetric_units_system="x")
    with pytest.raises(ValueError):
        parsing.ParseOptions(volumetric_units_system="us")


def test_units():
    assert [U.resolved(u) for u in ("cup", "c", "tbsp", "g", "fl oz", "pinch", "clove", "half-pint", "")] == ["cup", "cup", "tablespoon", "gram", "fluid_ounce", None, None, None, None]
    assert U.resolved("cup", "metric") == "metric_cup" and U.resolved("g", "imperial") == "gram"
    assert [U.system_of(u) for u in ("", "cup", "imperial_cup", "metric_cup", "gram", "clove")] == ["none", "us_customary", "imperial", "metric", "metric", "other"]
    own = parsing.ParseOptions(custom_units={"glugs": "glug"})
    assert texts(parsed("2 glug oil", "QUN", options=own)) == ["2 glugs"]


def test_parse(spark):
    weights = [("emission", "is_unit", "UNIT", 9), ("emission", "stem:!num", "QTY", 9), ("emission", "bias:", "B_NAME_TOK", 1), ("transition", "QTY", "UNIT", 1)]
    labels = ("QTY", "UNIT", "B_NAME_TOK", "I_NAME_TOK", "NAME_SEP", "PUNC")
    model = labelling.Model(spark.createDataFrame(weights, "kind string, feature string, label string, weight long"), labels)
    lexicon = spark.createDataFrame([("sugar", "NN")], "word string, tag string")
    df = spark.createDataFrame([(1, "1½ cups sugar"), (2, None), (3, ""), (4, "2 cups")], "k int, s string")
    got = {r.k: r for r in parsing.parse(df, ["k"], "s", lexicon, model).collect()}
    assert [t for t in got[1].tokens] == ["1#1$2", "cups", "sugar"] and got[1].parsed.amounts[0].text == "1 1/2 cups"
    assert [n.text for n in got[1].parsed.names] == ["sugar"] and got[1].parsed.size is None
    assert got[2].parsed is None and got[3].parsed is None and got[4].parsed.amounts[0].parts[0].value == 2.0
    uneven = spark.createDataFrame([(["a"], [False], ["NN"], ["QTY"], [0.5, 0.5])], "w array<string>, p array<boolean>, t array<string>, l array<string>, s array<double>")
    assert uneven.select(parsing.parse_labelled(*[F.col(c) for c in "wptls"]).alias("x")).first().x is None


def test_guessed():
    import numpy as np

    labels = ["QTY", "B_NAME_TOK", "I_NAME_TOK"]
    p = np.array([[0.9, 0.1, 0.0], [0.6, 0.3, 0.1], [0.5, 0.2, 0.3], [0.95, 0.05, 0.0]])
    assert labelling.guessed(["QTY"] * 4, p, labels) == ["QTY", "B_NAME_TOK", "I_NAME_TOK", "QTY"]
    assert labelling.guessed(["B_NAME_TOK"] + ["QTY"] * 3, p, labels)[1] == "QTY" and labelling.guessed(["QTY"], p[:1] * 0, labels) == ["QTY"]

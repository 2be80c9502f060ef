import pytest
from pyspark.sql import functions as F

from pantry.functions import normalise as N
from pantry.functions import tokens as T

CASES = [
    ("&frac14; jug cold brew (4°C)", "#1$4 jug cold brew (4°C)"), ("7 5/8 limes", "7#5$8 limes"), ("nine radishes", "nine radishes"),
    ("walnut-coloured crust", "walnut-coloured crust"), ("4 jars honey – runny", "4 jars honey - runny"), ("a—b", "a - b"), ("6–9 figs", "6-9 figs"),
    ("5⅛ cups broth", "5#1$8 cups broth"), ("3/4 cup oats", "#3$4 cup oats"), ("2 and 2/3 tbsp rum", "2#2$3 tbsp rum"), ("⅙-⅕ cup", "#1$6-#1$5 cup"),
    ("45ml rum", "45 ml rum"), ("7-ounce tin, drained", "7 ounce tin, drained"), ("two-cup jug", "two cup jug"), ("cup3", "cup 3"), ("5lb-3oz ham", "5 lb - 3 oz ham"),
    ("6 Tbsp. ghee", "6 Tbsp ghee"), ("3 to 7 plums", "3-7 plums"), ("8 or 9 dates", "8-9 dates"), ("11 - 12 nuts", "11-12 nuts"),
    ("90 g - 120 g veal", "90-120 g veal"), ("3 oz to 5 ounce veal", "3-5 oz veal"), ("3 g - 5 oz veal", "3 g - 5 oz veal"), ("6 X 33 cl ale", "6x 33 cl ale"),
    ("70/30 blend (£1,50**)", "70/30 blend"), ("salt &amp; lime", "salt & lime"), ("\t  ", ""), ("", ""), (None, None),
]
TOKENS = {
    "3 sprigs dill": ["3", "sprigs", "dill"], "tin [9 oz], full": ["tin", "[", "9", "oz", "]", ",", "full"],
    "lime and/or lemon": ["lime", "and/or", "lemon"], "nuts, e.g. pecans.": ["nuts", ",", "e.g.", "pecans", "."], "": [],
}


def test_normalise(spark):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CASES)], "i int, s string").select("i", N.normalise("s").alias("n")).collect()
    assert {r.i: r.n for r in rows} == {i: b for i, (_, b) in enumerate(CASES)}


def test_tokenize(spark):
    df = spark.createDataFrame([(k,) for k in TOKENS], "s string").select("s", T.tokenize("s").alias("t"))
    assert {r.s: list(r.t) for r in df.collect()} == TOKENS


@pytest.mark.parametrize(
    ("function", "yes", "no"),
    [
        (T.is_numeric, ["1", "1.5", "1_000", "nan", "#1$2", "1#1$2-2#1$2", "1-2", "two", "dozen", "8x", "one-half", "1e3", "one-two", "2x-3x", "One-Half", "+5", "٣"], ["00", "1d", "cup", "x", "", "a-b", "1-", "Dozen", "-5", "1e-5", "00-1", "#1$2x"]),
        (T.is_unit, ["cup", "Cup", "g", "oz"], ["cups", "inch", "flour"]),
        (T.is_punctuation, [",", "()", "--"], ["a", ",("]),
        (T.is_ambiguous_unit, ["clove", "Leaves", "gram"], ["cup", "GRAM"]),
    ],
)
def test_token_tests(spark, function, yes, no):
    df = spark.createDataFrame([(x,) for x in yes + no], "t string")
    assert {r.t for r in df.where(function(F.col("t"))).collect()} == set(yes)


def test_shapes_and_affixes(spark):
    row = spark.createDataFrame([("Crème12-b",)], "t string").select(T.word_shape("t").alias("s"), *[c.alias(n) for c, n in zip(T.affixes("t", 3), "ab")]).first()
    assert tuple(row) == ("Xxxxxdd-x", "Crè", "2-b")

import numpy as np
import pytest
import sentencepiece

from pantry.llm import sentencepiece_viterbi as S

ODD = [
    "", " ", "   ", "a", "Hello  world\nfoo\t x", "你   好 你好", "\U0001F600\U0001F600", "tab\tand\r\n", "naïve café ÉCOLE", " lead and trail  ", "x" * 3000,
    "aaaaaaaaabababababab" * 20, "####   ====", "1234567890 3.14159", "​ zero ́", "é", "<s> </s> <unk> <0x0A>", "ﬁ Ⅷ ½",
]


@pytest.fixture(scope="module")
def model():
    return S.Model(S.load_model())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=S.MODEL_FILE)


def texts():
    rng = np.random.default_rng(4)
    syllables = ["th", "er", "ing", "tion", "é", "ou", "st", "an", "re", "ñ", "A", "The", ",", ".", "ß", "qu", "zz", "00", "-"]
    made = [" ".join("".join(rng.choice(syllables, rng.integers(1, 8))) for _ in range(40)) for _ in range(120)]
    noise = ["".join(rng.choice(list("abc  é\n你#"), 60)) for _ in range(60)]
    return ODD + made + noise


def test_equal_to_the_library(model, library):
    for text, ids in zip(texts(), model.encode(texts())):
        assert ids.tolist() == library.encode(text), text
        assert model.decode(ids) == library.decode(ids.tolist()) == text


def test_unigram_states_are_viterbi(model):
    pieces = {"a": -1.0, "b": -2.0, "ab": -2.5, "abc": -3.1, "c": -1.5, "bc": -3.4, "▁": -1.0, "▁a": -1.2}
    small = S.Model.__new__(S.Model)
    small.kind, small.ids, small.scores, small.longest = S.UNIGRAM, {p: i for i, p in enumerate(pieces)}, list(pieces.values()), 3

    def best(word):
        if not word:
            return 0.0, []
        return max((best(word[n:])[0] + pieces[word[:n]], [word[:n], *best(word[n:])[1]]) for n in range(1, 4) if word[:n] in pieces)

    words = sorted({"▁abc", "▁abcab", "abab", "cabc", "▁a"})
    for word, last in small._unigram_states(words):
        got, end = [], len(word)
        while end:
            got.insert(0, last[end])
            end -= len(last[end])
        assert sum(pieces[p] for p in got) == pytest.approx(best(word)[0])


def test_documents_round_trip(spark, library):
    rows = [(i, t) for i, t in enumerate(texts())] + [(3, ODD[3]), (None, "no id"), (900, None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, ids int")
    found = S.encode_documents(df)
    got = sorted(((r.doc_id, list(r.ids), r.n_tokens, r.round_trip) for r in found.collect()), key=repr)
    assert got == sorted(((i, w := library.encode(t or ""), len(w), True) for i, t in rows), key=repr)
    back = sorted(((r.doc_id, r.text) for r in S.decode_documents(found).collect()), key=repr)
    assert back == sorted(((i, t or "") for i, t in rows), key=repr)
    assert S.encode_documents(df.limit(0)).count() == 0

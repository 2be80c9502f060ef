import zlib

import numpy as np

from pantry.llm import quality as Q


def corpus(n=400):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        own = list(rng.choice(words, rng.integers(20, 120)))
        good = i % 3 != 0
        docs.append((i, " ".join(own) if good else " ".join(w.upper() + "!!" for w in own)))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy_and_contract(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([(*d, "q", 0.5) for d in docs], "doc_id long, text string, quality string, score double")
    found = Q.classify(df, Q.learn(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    assert len(found) == len(docs)
    truth = {a: q for a, q, _ in labels}
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in found if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_held_out_labels_teach_nothing(spark):
    docs, labels = corpus(200)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    flipped = [(a, 1 - q if zlib.crc32(str(a).encode()) % 5 == 0 else q, 0) for a, q, _ in labels]
    one, two = (Q.learn(df, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert one == two


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "x" * 300_000), (3, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None), (3, 0), (3, 1)], "doc_id long, quality int")
    model = Q.learn(df, labels)
    got = Q.classify(df, model).collect()
    assert len(got) == 5 and all(r.score is not None and r.held_out is not None for r in got)
    assert Q.classify(df.limit(0), Q.learn(df.limit(0), labels.limit(0))).count() == 0
    assert Q.keep_good(df, model).columns == df.columns


def test_whole_texts_teach_and_order_does_not(spark):
    """A good and a bad text that differ only far behind their beginnings; rows that share a doc_id."""
    docs, labels = corpus(60)
    start = "same words at the start of all of them " * 1000
    docs = [(i, start + t * 10) for i, t in docs] + [(i, "another version") for i, _ in docs[:30]]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    one, two = (Q.learn(spark.createDataFrame(x, "doc_id long, text string").repartition(n), lab) for x, n in ((docs, 2), (docs[::-1], 5)))
    assert one == two
    rows = Q.labelled(spark.createDataFrame(docs, "doc_id long, text string"), lab, 1500)[0]
    whole = sum(-(-len(r.text.encode()) // Q.TRAIN_PIECE) for r in rows.collect())
    assert sum(map(len, Q.pieces_of(rows, 10**6).values())) == whole and all(len(x) == 7 for x in Q.pieces_of(rows, 7).values())


def test_differences_against_brute_force(spark):
    """Scores are what compressing every piece by itself gives."""
    import zstandard

    docs, labels = corpus(120)
    df = spark.createDataFrame([*docs, (900, docs[1][1] * 400)], "doc_id long, text string")
    model = Q.learn(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    text = dict([*docs, (900, docs[1][1] * 400)])

    def size(t, dictionary):
        data = t.encode()
        make = lambda: zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(make().compress(data[a : a + Q.PIECE])) for a in range(0, len(data), Q.PIECE))

    for r in Q.classify(df, model).collect():
        b, g = size(text[r.doc_id], model.bad), size(text[r.doc_id], model.good)
        z = model.slope * (b - g) / (b + g) + model.offset
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9

import importlib

import numpy as np


def corpus(tmp_path, spark):
    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 8))) for _ in range(300)]
    text = lambda n: "\n".join(" ".join(rng.choice(words, 12)) for _ in range(n))
    docs, labels = [], []
    for i in range(120):
        good = i % 4 != 0
        t = text(int(rng.integers(3, 12)))
        docs.append((i, t if good else " ".join(w.upper() + "!!" for w in t.split()), "en", "s", 1))
        labels.append((i, int(good), 0))
    item = " ".join(rng.choice(words, 30))
    line = " ".join(rng.choice(words, 14))
    near = text(20).replace("\n", " ")
    docs += [(201, near, "en", "s", 1), (202, near.replace("a", "A", 3), "en", "s", 1), (203, text(2) + "\n" + item, "en", "s", 1)]
    docs += [(204, line + "\n" + text(4), "en", "s", 1), (205, text(4) + "\n" + line, "en", "s", 1), (206, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs, line


def test_stages(spark, tmp_path):
    P = importlib.import_module("corpus_pipeline")
    docs, line = corpus(tmp_path, spark)
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = now.columns
    seen = {}
    for name, stage in P.STAGES:
        now = stage(spark, now, str(tmp_path))
        if name != P.STAGES[-1][0]:
            assert now.columns == columns
            now = spark.createDataFrame(now.collect(), now.schema)
            seen[name] = {r.doc_id: r for r in now.collect()}
    assert len([i for i in seen["quality"] if i < 120 and i % 4]) == 90 and len([i for i in seen["quality"] if i < 120 and i % 4 == 0]) <= 3
    assert line in seen["lines"][204].text and line not in seen["lines"][205].text
    assert seen["lines"][205].n_chars == len(seen["lines"][205].text)
    assert 203 in seen["near_duplicates"] and 203 not in seen["benchmark"]
    assert 201 in seen["near_duplicates"] and 202 not in seen["near_duplicates"]
    last = {r.doc_id: r.n_tokens for r in now.collect()}
    assert last.keys() == seen["benchmark"].keys() and {r.doc_id: r.n_tokens for r in P.run(spark, str(tmp_path)).collect()} == last

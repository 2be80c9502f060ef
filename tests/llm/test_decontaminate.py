import hashlib
import re

import numpy as np

from pantry.llm import decontaminate as D


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, w=13):
    out = []
    for doc_id, text in docs:
        own = words(text)
        hit, names = set(), set()
        for item_id, t in items:
            it = words(t)
            if not it or item_id is None:
                continue
            n = min(w, len(it))
            wins = {tuple(it[i : i + n]) for i in range(len(it) - n + 1)}
            for i in range(len(own) - n + 1):
                if tuple(own[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    names.add(str(item_id))
        out.append((str(doc_id), len(own), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(own)))
    return sorted(out)


def fixture():
    rng = np.random.default_rng(8)
    vocabulary = ["the", "of", "é", "naïve", "x1", "and", "to", "B"]
    make = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, make(int(rng.integers(1, 40)))) for i in range(25)] + [(90, "the the the the the the the the the the the the the the the"), (91, ""), (92, None), (None, make(20)), (93, "solo")]
    items.append((5, items[5][1]))
    docs = []
    for i in range(60):
        own = make(int(rng.integers(0, 60))).split()
        for k in rng.choice(25, 2):
            it = items[k][1].split()
            a = int(rng.integers(0, len(it)))
            own[len(own) // 2 : len(own) // 2] = it[a : a + int(rng.integers(1, 30))]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(own).title()))
    docs += [(100, None), (101, ""), (102, "the " * 50), (None, items[7][1]), (3, docs[3][1]), (103, "Solo"), (104, "--- ... ")]
    return docs, items


def test_against_brute_force(spark):
    docs, items = fixture()
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, n_words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    for size in (500_000, 20):
        got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.contamination(d, b, block_words=size).collect())
        assert got == brute(docs, items)
    assert D.contamination(d.limit(0), b).count() == 0
    assert {r.n_hit for r in D.contamination(d, b.limit(0)).collect()} == {0}


def test_remove(spark):
    docs, items = fixture()
    docs.append((105, " ".join(f"w{i}" for i in range(5000)) + " " + items[7][1] + " end"))  # far below a twentieth
    docs.append((106, "--- ... ???"))
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, n_words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    clean = sorted((str(a), t) for a, t in docs if brute([(a, t)], items)[0][2] == 0)
    assert 0 < len(clean) < len(docs)
    for size in (500_000, 20):
        left = D.remove_contaminated(d, b, block_words=size)
        assert left.columns == d.columns
        assert sorted((str(r.doc_id), r.text) for r in left.collect()) == sorted(clean, key=lambda x: (x[0], x[1] or ""))
        assert {r.n_hit for r in D.contamination(left, b).collect()} == {0}
    assert D.remove_contaminated(d, b.limit(0)).count() == len(docs)


def test_words_that_both_sides_repeat():
    import time

    times = []
    for n in (20_000, 80_000):
        index = D.Index([("a", "the " * n), ("b", "the " * 13), ("c", "the " * 12)], 13, 5)
        start = time.time()
        found = D.find(["the " * n + "end", "the " * 11], index)
        times.append(time.time() - start)
        assert found[0][0] == n + 1 and found[0][1][0] == (0, n) and found[0][2] == {"a", "b", "c"} and found[1] == (11, [], set())
    assert times[1] < 12 * times[0] + 1  # in proportion, not with the square


def test_windows_with_equal_hashes(monkeypatch):
    docs, items = fixture()
    plain = D._grams
    monkeypatch.setattr(D, "_grams", lambda h, n: plain(h, n) % np.uint64(7))
    monkeypatch.setattr(D, "_mix", lambda x: x % np.uint64(7))
    index = D.Index([(str(i), t) for i, t in items if i is not None], 13, 5)
    assert index.odd
    got = sorted((str(i), *D._summary(*x)) for (i, _), x in zip(docs, D.find([t for _, t in docs], index)))
    assert got == brute(docs, items)


def test_segments_do_not_change_hashes(monkeypatch):
    data = b" ".join(b"w%d" % i for i in range(500)) + b" " + b"z" * 400
    whole = D.words_of(data)
    monkeypatch.setattr(D, "_SEGMENT", 50)
    parts = D.words_of(data)
    assert all((a == b).all() for a, b in zip(whole, parts))

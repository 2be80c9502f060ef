import importlib

import numpy as np

from pantry.llm import shingle_dedup as D


def jaccard(a, b, k=5):
    def grams(text):
        ws = (text or "").lower().split()
        return {" ".join(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def fixture():
    """Bases with a copy each at 0.80 to 0.95 and some below 0.8, a star around one base, and odd rows."""
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(900)]
    rows = []

    def changed(words, n):
        out = list(words)
        for p in rng.choice(len(out), n, replace=False):
            out[p] = "".join(rng.choice(list("klmnop"), 6))
        return " ".join(out)

    for i in range(100):
        words = list(rng.choice(vocabulary, 300))
        rows += [(10 * i, " ".join(words)), (10 * i + 1, changed(words, 1 + i % 12))]
    words = list(rng.choice(vocabulary, 300))
    rows += [(5000 + i, changed(words, 4)) for i in range(60)] + [(4999, " ".join(words).upper())]
    return rows + [(6000, None), (6001, ""), (6002, " \n"), (6003, "one"), (6004, "ONE"), (6005, "a b"), (0, rows[0][1])]


def components(rows):
    root = list(range(len(rows)))
    near = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(rows[i][1], rows[j][1]) >= 0.8]
    for _ in rows:
        before = list(root)
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    return {rows[i][0]: min(rows[j][0] for j in range(len(rows)) if root[j] == root[i]) for i in range(len(rows))}


def test_against_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = components(rows)
    by = {i: t for i, t in rows}
    at = [jaccard(by[10 * i], by[10 * i + 1]) for i in range(100)]
    assert min(at) < 0.8 and all(any(x <= s < x + 0.05 for s in at) for x in (0.8, 0.85, 0.9, 0.95))
    got = D.near_duplicates(df).collect()
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == want
    stage = dict(importlib.import_module("corpus_pipeline").STAGES)["near_duplicates"]
    assert {r.doc_id for r in stage(spark, df, "").collect()} == set(want.values())


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "one two"), (3, "one two"), (None, "three")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in D.near_duplicates(df).collect()} == {(None, 3), (3, 3), (None, None)}
    assert D.near_duplicates(df.limit(0)).count() == 0


def test_prefixes_of_similar_sets_meet():
    """Whatever the order, two sets at 0.8 or more share a value of their prefixes."""
    rng = np.random.default_rng(2)
    for _ in range(400):
        base = np.unique(rng.integers(-(2**62), 2**62, rng.integers(1, 60)))
        other = np.unique(np.concatenate((base[rng.random(len(base)) < rng.choice([0.8, 0.9, 1.0])], rng.integers(-(2**62), 2**62, rng.integers(0, 8)))))
        common = len(np.intersect1d(base, other))
        if 100 * common >= 80 * (len(base) + len(other) - common):
            counts = rng.integers(0, 4, D.SLOTS)
            assert len(np.intersect1d(D.prefix(base, counts, 80), D.prefix(other, counts, 80)))


def test_group_with_a_common_passage(spark):
    """Texts that share a passage, and therefore bands, but are less than 0.8 alike, do not become pairs."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    passage = [word() for _ in range(120)]
    rows = [(i, " ".join(passage + [word() for _ in range(60)])) for i in range(80)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in D.near_duplicates(df).collect()}
    assert got == components(rows) and got[103] == 3 and got[50] == 50
    sets = spark.createDataFrame([(i, [int(x) for x in D.shingles(t).view(np.int64)]) for i, t in rows], "node long, shingles array<long>")
    sizes = [r["count"] for r in D.prefixes(sets, 80).groupBy("key").count().collect()]
    assert sizes and max(sizes) == 2


def test_bitmaps_leave_out_no_similar_pair(spark):
    """Bitmaps differ in no more bits than sets in values, so every pair at 0.8 or more passes; pairs well below it mostly do not."""
    rng = np.random.default_rng(4)
    rows, similar = [], set()
    for i in range(600):
        base = np.unique(rng.integers(0, 2**64, rng.integers(1, 400), dtype=np.uint64))
        keep = base[rng.random(len(base)) < (rng.choice([0.9, 0.95, 1.0]) if i % 2 else 0.7)]
        other = np.unique(np.concatenate((keep, rng.integers(0, 2**64, len(base) - len(keep), dtype=np.uint64))))
        differ = len(np.setxor1d(base, other))
        assert sum(int(x).bit_count() for x in (D.marks(base) ^ D.marks(other)).view(np.uint64)) <= differ
        if 180 * (len(base) + len(other) - differ) >= 160 * (len(base) + len(other)):
            similar.add(i)
        rows.append((i, len(base), len(other), D.marks(base).tolist(), D.marks(other).tolist()))
    df = spark.createDataFrame(rows, "i int, n int, m int, marks array<long>, of_other array<long>")
    passed = {r.i for r in df.where(D.may_be_similar(80)).collect()}
    assert similar and similar <= passed and len(passed - similar) < 0.1 * (600 - len(similar))
    assert len(D.marks(np.zeros(0, np.uint64))) == D.MARKS


def test_group_of_copies_that_are_not_similar_enough(spark):
    """Copies of one text with as many changes as leave most pairs between 0.5 and 0.8."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    base = [word() for _ in range(150)]
    rows = []
    for i in range(70):
        words = list(base)
        for p in rng.choice(150, 1 + i % 7, replace=False):
            words[p] = word()
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in D.near_duplicates(df).collect()} == components(rows)


def test_simhash_names_candidates_first(spark, monkeypatch):
    """The stage asks SimHash's blocks, over fingerprints of five words; what they connect is what brute force over fingerprints does."""
    rows = fixture()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    asked, own = [], D.simhash_dedup.links
    monkeypatch.setattr(D.simhash_dedup, "links", lambda fps, *more: asked.append(({r.fp % 2**64 for r in fps.collect()}, more)) or own(fps, *more))
    stage = dict(importlib.import_module("corpus_pipeline").STAGES)["near_duplicates"]
    stage(spark, df, "")
    prints = {D.simhash_dedup.fingerprint(t, 5) for _, t in rows if (t or "").split()}
    assert asked == [(prints, (4, 7))]

    fp_of = {D.node(D.shingles(t)): D.simhash_dedup.fingerprint(t, 5) for _, t in rows if (t or "").split()}
    root = {x: x for x in fp_of}

    def join(pairs):
        at = dict(root)
        for _ in at:
            before = dict(at)
            for a, b in pairs:
                at[a] = at[b] = min(at[a], at[b])
            if at == before:
                return at

    want = [(a, b) for a in fp_of for b in fp_of if a < b and (fp_of[a] ^ fp_of[b]).bit_count() <= 4]
    got = [(r.node, r.other) for r in D.near_fingerprints(D.with_bands(df, 5, 4, 5), 4, 7).collect()]
    assert want and all((fp_of[a] ^ fp_of[b]).bit_count() <= 4 for a, b in got) and join(got) == join(want)

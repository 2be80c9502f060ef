import hashlib

import numpy as np
import pytest

from pantry.llm import suffix_dedup as S


def brute(rows, length=50):
    first = {}
    for i, t in rows:
        d = (t or "").encode()
        i = S.LAST if i is None else i
        for a in range(len(d) - length + 1):
            first[d[a : a + length]] = min(i, first.get(d[a : a + length], i))
    out = []
    for i, t in rows:
        d = (t or "").encode()
        gone = np.zeros(len(d), bool)
        for a in range(len(d) - length + 1):
            if first[d[a : a + length]] < (S.LAST if i is None else i):
                gone[a : a + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(d), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=repr)


def fixture():
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdé"), rng.integers(1, 6)))
    vocabulary = [word() for _ in range(40)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    base = [text(60) for _ in range(6)]
    rows = []
    for i in range(70):
        b = base[i % 6]
        a = int(rng.integers(0, len(b) - 40))
        rows.append((int(i * 11 % 71), text(int(rng.integers(0, 25))) + b[a : a + int(rng.integers(30, 200))] + text(int(rng.integers(0, 25)))))
    rows += [(100 + i, rows[0][1]) for i in range(5)] + [(200, None), (201, ""), (202, "short"), (None, rows[2][1]), (None, base[0]), rows[3], rows[3], (5, base[1])]
    rows += [(300, "a" * 400), (301, "a" * 300 + "b"), (302, "ab" * 200), (303, "b" + "ab" * 30), (304, "\0" * 120), (305, "x" + "\0" * 90)]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_index_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    strings = sorted({bytes(rng.choice(list(b"ab"), int(rng.integers(12, 40))).astype(np.uint8)) for _ in range(60)})
    owners = np.sort(rng.integers(0, 20, len(strings)))
    index = S.RunLengthIndex(strings, owners, 12)
    queries = [*strings, b"abababababababccabababab", b"c", b"bbbbbbbbbbbbbbbbbbbbbbbb"]
    everywhere = b"\xff".join(strings)
    for who, at, match, _ in index.statistics(queries):
        for q, a, n in zip(who, at, match):
            rest = queries[q][a:]
            assert rest[:n] in everywhere and (n == len(rest) or rest[: n + 1] not in everywhere)
    got = set(zip(*(x.tolist() for x in index.marks(strings, owners))))
    want = {(i, a) for i, s in enumerate(strings) for a in range(len(s) - 11) if any(s[a : a + 12] in t for t, o in zip(strings, owners) if o < owners[i])}
    assert got == want


def test_against_brute_force(spark, tmp_path):
    rows = fixture()
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, tag int")
    df.repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    got = S.op10_suffix_dedup(spark, str(tmp_path))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)
    for most, size in ((2, 1 << 20), (20_000, 500)):
        found = S.remove_repeats(df.repartition(5), most=most, index_bytes=size).collect()
        small = sorted(((r.doc_id, sum(s.stop - s.start for s in r.spans or ()), len(r.spans or ())) for r in found), key=repr)
        assert small == sorted(((w[0], w[2], w[3]) for w in brute(rows)), key=repr)
    assert S.remove_repeats(df.limit(0)).count() == 0


def test_versions_and_texts_without_an_id(spark):
    """Many texts under one doc_id, or none: each looks at its own names, and finds what any version has."""
    rng = np.random.default_rng(10)
    text = lambda n: "".join(rng.choice(list("abcdef "), n))
    shared = [text(80) for _ in range(30)]
    rows = [(None, text(60) + shared[i % 30] + text(60)) for i in range(120)] + [(7, text(100) + shared[i]) for i in range(30)] + [(9, shared[i] + text(30)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    names = S.shared_names(df, 50).groupBy("key").count().agg({"count": "max"}).first()[0]
    assert names < 40
    got = sorted(((r.doc_id, sum(s.stop - s.start for s in r.spans or ()), len(r.spans or ())) for r in S.remove_repeats(df).collect()), key=repr)
    assert got == sorted(((w[0], w[2], w[3]) for w in brute(rows)), key=repr)


def test_long_text_over_slice_cuts(spark):
    rng = np.random.default_rng(11)
    long = "".join(chr(97 + i) for i in rng.integers(0, 26, (2 << 20) + 5000))
    rows = [(1, long), (2, "x" + long[-3000:] + "y"), (3, "z" + long[1 << 20 : (1 << 20) + 60])]
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, [tuple(s) for s in r.spans or ()]) for r in got) == [(1, []), (2, [(1, 3001)]), (3, [(1, 61)])]

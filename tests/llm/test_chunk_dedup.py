import numpy as np

from pantry.llm import chunk_dedup as C


def test_gear_is_the_rolling_recurrence():
    data = np.random.default_rng(0).integers(0, 256, 300).astype(np.uint8)
    h, want = 0, []
    for b in data:
        h = (2 * h + int(C.GEAR[b])) & 0xFFFF
        want.append(h)
    assert C.gear_hashes(data).tolist() == want


def test_cuts_cover_and_resist_shifts():
    rng = np.random.default_rng(1)
    data = bytes(rng.integers(97, 123, 5000).astype(np.uint8))
    ends = C.cuts(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.min() > 0 and sizes.max() <= C.MOST and (sizes[:-1] >= C.LEAST).all()
    moved = {e - 7 for e in C.cuts(b"seven!!" + data)}
    assert len(moved & set(ends)) > 0.95 * len(ends)
    assert C.cuts(b"") == [] and C.cuts(b"a" * 1000)[-1] == 1000


def brute(rows, least):
    seen, cut = {}, {}
    for i, t in rows:
        data = (t or "").encode()
        ends = C.cuts(data)
        for a, b in zip([0, *ends], ends):
            seen.setdefault(data[a:b], []).append(C.LAST if i is None else i)
    out = []
    for i, t in rows:
        data, own, runs = (t or "").encode(), set(), []
        ends = C.cuts(data)
        for a, b in zip([0, *ends], ends):
            if data[a:b] in own or min(seen[data[a:b]]) < (C.LAST if i is None else i):
                if runs and runs[-1][1] == a:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
            own.add(data[a:b])
        runs = [(a, b) for a, b in runs if b - a >= least]
        left = "".join(data[a:b].decode("utf-8", "ignore") for a, b in zip([0, *[r[1] for r in runs]], [*[r[0] for r in runs], len(data)]))
        out.append((i, len(data), sum(b - a for a, b in runs), len(runs), tuple(runs), left if t is not None else None))
    return sorted(out, key=repr)


def fixture():
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdéefgh"), rng.integers(2, 9)))
    vocabulary = [word() for _ in range(500)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    shared = [text(60) for _ in range(4)]
    rows = [(i, text(40) + " " + shared[i % 4] + " " + text(int(rng.integers(1, 60)))) for i in range(40)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (None, rows[5][1]), (None, "new " + text(30)), (7, rows[7][1]), (8, text(90)), (200, None), (201, ""), (202, "ab" * 3000), (203, shared[0] * 3)]
    return rows


def test_against_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, spans string")
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, tuple((s.start, s.end) for s in r.spans)) for r in C.measured(df).collect()]
    want = brute(rows, 64)
    assert sorted(got, key=repr) == [w[:5] for w in want]
    assert sum(w[2] > 100 for w in want) > 30
    left = C.remove_repeats(df)
    assert left.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(((w[0], w[5]) for w in want), key=repr)
    assert C.measured(df.limit(0)).count() == 0


def test_versions_that_short_tags_would_mix_up(spark):
    import xxhash

    rng = np.random.default_rng(3)
    seen, pair = {}, None
    while pair is None:
        t = "".join(rng.choice(list("abcdefgh "), 650))
        k = xxhash.xxh64_intdigest(t.encode(), 42) & 0xFFFFFF
        pair = (seen[k], t) if k in seen else None
        seen[k] = t
    a, b = pair
    rows = [(1, a), (7, a), (7, b), (None, a), (None, b + "?")]
    got = C.measured(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows, 64)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in got), key=repr) == [w[:3] for w in want]


def test_long_text_over_batch_cuts(spark):
    rng = np.random.default_rng(4)
    long = "".join(chr(97 + i) for i in rng.integers(0, 26, (1 << 20) + 5000))
    rows = [(1, long), (2, "x" + long[-3000:]), (3, long)]
    got = C.measured(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in got) == [w[:4] for w in brute(rows, 64)]

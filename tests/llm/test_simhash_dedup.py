import numpy as np
import xxhash

from pantry.llm import simhash_dedup as S


def brute(rows, k=4, most=4):
    """rows of (doc_id, text) -> {row number: (fingerprint, component)}"""
    import re

    fps = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= most:
                    root[i] = root[j] = min(root[i], root[j])
    names = {r: min([rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None], default=None) for r in set(root)}
    return sorted((rows[i][0] is None, rows[i][0], f"{fps[i]:016x}", names[root[i]]) for i in range(len(rows)))


def fixture():
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]
    rows = []
    for i in range(30):
        words = list(rng.choice(vocabulary, 300))
        rows.append((1000 - 7 * i, " ".join(words)))
        if i % 3 == 0:
            words[17] = "Changed"
            rows.append((7 * i + 1, "\n".join(words)))
        if i % 5 == 0:
            rows.append((7 * i + 3, "  ".join(words).upper()))
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "one"), (5004, "ONE"), (5005, "a b c"), (1000, rows[0][1])]
    return rows


def result(df):
    return sorted((r.doc_id is None, r.doc_id, r.fingerprint, r.component_id) for r in df.collect())


def test_against_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, fp string")
    assert result(S.near_duplicates(df)) == brute(rows)
    assert result(S.near_duplicates(df, chunk_rows=2)) == brute(rows)


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "one two"), (3, "one two"), (None, "three")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in S.near_duplicates(df).collect()}
    assert got == {(None, 3), (3, 3), (None, None)}
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_links_keep_what_chains_connect(spark):
    rng = np.random.default_rng(5)
    fps = []
    for seed in rng.integers(0, 2**63, 20, dtype=np.uint64):
        now = int(seed)
        for _ in range(30):
            fps.append(now)
            for bit in rng.choice(64, 4, replace=False):
                now ^= 1 << int(bit)
    fps = sorted(set(fps))
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")

    def classes(pairs):
        root = {x: x for x in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        return {x: find(x) for x in fps}

    want = classes([(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 4])
    for rows in (4096, 3):
        got = S.links(df, chunk_rows=rows).collect()
        assert all(((r.u ^ r.v) & (2**64 - 1)).bit_count() <= 4 for r in got)
        assert classes([(r.u % 2**64, r.v % 2**64) for r in got]) == want


def test_keep_one(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    stay = {r[3] for r in brute(rows)}
    assert {r.doc_id for r in S.keep_one(df).collect()} == stay


def test_shared_keys_are_not_broadcast(spark, tmp_path):
    """A small table of fingerprints has 35 times as many keys, which Spark's estimate leaves out."""
    spark.range(300_000).selectExpr("xxhash64(id DIV 2) ^ (id % 2) AS fp").write.parquet(f"{tmp_path}/fps")
    found = S.links(spark.read.parquet(f"{tmp_path}/fps"))
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 150_000
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()

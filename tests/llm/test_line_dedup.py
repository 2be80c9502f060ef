from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pantry.llm import line_dedup as L

A, B, C = (x * 5 + " a line of some length" for x in "ABC")


@given(st.permutations(range(12)), st.integers(0, 12))
@settings(max_examples=300, deadline=None)
def test_chains_rise_and_leave_nothing_out(order, n):
    pairs = list(zip(order[:n], range(0, 2 * n, 2)))
    chains = L.patience(pairs)
    assert sorted(p for c in chains for p in c) == sorted(pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for c in chains for p, q in zip(c, c[1:]))
    longest = [1] * n
    for i in range(n):
        longest[i] = 1 + max([longest[j] for j in range(i) if order[j] < order[i]] + [0])
    assert len(chains[0]) == max(longest) if n else chains == []


def test_blocks_are_neighbours_in_both():
    assert L.blocks_of([(0, 3), (1, 4), (5, 6), (6, 7), (9, 8)]) == [(0, 3, 2), (5, 6, 2), (9, 8, 1)]


def numbered(lines, big):
    seen, out = Counter(), {}
    for at, x in enumerate(lines):
        if big(x):
            out[x, seen[x]] = at
            seen[x] += 1
    return out


def gone_by(theirs, own, big):
    """Lines of own that a block shared with theirs covers."""
    gone, other = set(), numbered(theirs, big)
    for key, y in numbered(own, big).items():
        if key not in other:
            continue
        gone.add(y)
        for step in (-1, 1):
            i, j = other[key] + step, y + step
            while 0 <= i < len(theirs) and 0 <= j < len(own) and theirs[i] == own[j] and not big(own[j]):
                gone.add(j)
                i, j = i + step, j + step
    return gone


def brute(rows, least=20):
    """Every document with every earlier one."""
    big = lambda x: len(x.strip(" ")) >= least
    good = [(i, t.split("\n")) for i, t in rows if i is not None and t is not None]
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, 0, 0, ""))
            continue
        own, gone = t.split("\n"), set()
        if i is not None:
            for e, theirs in good:
                if e < i:
                    gone |= gone_by(theirs, own, big)
        out.append((i, len(own), len(gone), "\n".join(x for n, x in enumerate(own) if n not in gone)))
    return sorted(out, key=repr)


def fixture():
    rng = np.random.default_rng(6)
    long_line = lambda: "".join(rng.choice(list("abcdefghij klm"), 30)) + "."
    pool = [long_line() for _ in range(60)] + ["", "short", "As.", "é" * 19, "é" * 20] * 3
    rows = []
    for i in range(80):
        ls = list(rng.choice(pool, rng.integers(1, 9)))
        if i % 4 == 0 and rows:
            a = rows[int(rng.integers(len(rows)))][1].split("\n")
            ls[1:1] = a[: int(rng.integers(1, len(a) + 1))]
        if i % 5 == 0 and rows:
            ls = list(rng.permutation(ls + rows[int(rng.integers(len(rows)))][1].split("\n")))
        rows.append((int(i * 7 % 83), "\n".join(ls)))
    rows += [(500 + i, rows[0][1]) for i in range(6)] + [(700, None), (701, ""), (None, rows[0][1]), (3, "another version\n" + pool[5]), rows[4], rows[4], (702, "\n".join(pool[:50]))]
    return rows + [(703, "\n".join([pool[7], "", "", "x"] * 300)), (704, "\n".join([pool[7], "", "", "x"] * 400))]


def result(found):
    return sorted(((r.doc_id, r.n_lines, r.n_deleted, r.text or "") for r in found.collect()), key=repr)


def test_against_all_pairs(spark, monkeypatch):
    rows = fixture()
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, text string, keep int, tag string").repartition(5)
    got = L.dedup_lines(df)
    assert got.columns == [*df.columns, "n_lines", "n_deleted"]
    assert result(got) == brute(rows)
    assert L.dedup_lines(df.limit(0)).count() == 0
    monkeypatch.setattr(L, "HOT", 2)  # most lines take the other way
    assert result(L.dedup_lines(df.select("text", "doc_id"))) == brute(rows)


@given(st.lists(st.lists(st.sampled_from([A, B, C, "", "x"]), max_size=7), max_size=5))
@settings(max_examples=200, deadline=None)
def test_first_holders_are_enough(texts):
    """The anchors alone, without Spark: what first holders share covers what all earlier ones do."""
    big = lambda x: len(x) >= 20
    first: dict[bytes, int] = {}
    for i, lines in enumerate(texts):
        found = L.anchors("\n".join(lines).encode(), 20) if lines else []
        own = {at for at, name in found if first.setdefault(name, i) < i}
        assert own == set().union(*(gone_by(texts[e], lines, big) for e in range(i)))


def kept(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.text for r in L.dedup_lines(df).collect()}


def test_lines_that_documents_repeat(spark):
    texts = [f"{A}\n{A}", f"{A}\n{A}", f"{B}\nx\n{B}\ny", f"{B}\nnew", f"{C}\nz\n{C}\nz\n{C}", f"{C}\nq\n{C}"]
    assert kept(spark, texts) == {0: texts[0], 1: "", 2: texts[2], 3: "new", 4: texts[4], 5: "q"}


def test_lines_in_another_order_are_found(spark):
    texts = [f"{A}\n{B}", f"{B}\n{A}", f"{B}\n{A}", "x"]
    assert kept(spark, texts) == {0: texts[0], 1: "", 2: "", 3: "x"}


def test_blocks_name_both_places(spark):
    df = spark.createDataFrame([(1, f"q\n{A}\n\n{B}\n{C}"), (2, f"{C}\nnew\n{A}\n\n{B}")], "doc_id long, text string")
    row = L.aligned_blocks(L.overlaps(df)[0]).collect()[0]
    assert (row.doc, [tuple(b) for b in row.blocks]) == (2, [(1, 4, 0, 1), (1, 1, 2, 3)])


def test_columns_named_like_added_ones(spark):
    df = spark.createDataFrame([(1, A, 7, "a"), (2, A, 8, "b")], "doc_id long, text string, n_lines int, tag string")
    got = L.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "tag", "n_lines", "n_deleted"]
    assert sorted(tuple(r) for r in got.collect()) == [(1, A, "a", 1, 0), (2, "", "b", 1, 1)]

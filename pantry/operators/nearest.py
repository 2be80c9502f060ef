"""The nearest rows by cosine distance, exactly, without a row for each pair.

All queries meet all rows, which is quadratic where the queries are a share of the rows; what a pair costs is a few
nanoseconds, and no pair leaves its cell but the best k of each query. A cell holds at most some ten thousand queries and
rows, about evenly dealt, whatever the size of the tables. Products of unit vectors name the candidates: rows that are no
farther than the k-th best by more than rounding and sums can change. Their distances are summed again in the order of the
dimensions, rounded, and ranked, ties by id.

Distances of a vector of no length (or with infinite or NaN components) are NaN and come after all others; those
of null vectors, of vectors with null components and of vectors of different length are null and come last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval import rounded

#: Numbers in one side of a cell, and distances that are held at once.
CELL, HELD = 1 << 22, 1 << 21


def _in_order(a: np.ndarray, b: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Products of a's rows and b's, summed as a loop over the dimensions does."""
    out = np.zeros(len(rows))
    for x, y in zip(a.T, b.T):
        out += x[rows] * y[cols]
    return out


def search(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, places: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """queries(m, d) and their ids, vectors(n, d) and theirs in rising order -> (query, vector, distance) as numbers of rows,
    in any order: the first k of each query, and maybe further ones. NaN counts as a distance."""
    m, n, d = len(queries), len(vectors), queries.shape[1]
    every = np.arange(max(m, n))
    with np.errstate(all="ignore"):
        a, b = (np.sqrt(_in_order(x, x, every[: len(x)], every[: len(x)])) for x in (queries, vectors))
        left, right = queries / a[:, None], np.ascontiguousarray((vectors / b[:, None]).T)
        first, last = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
        slack, step = 10.0**-places * (1 + 1e-6) + (d + 8) * 1e-14, max(1, HELD // max(n, 1))
        for at in range(0, m, step):
            near = left[at : at + step] @ right
            unknown = None if np.isfinite(near.sum()) else ~np.isfinite(near)
            near[~np.isfinite(near)] = -np.inf
            for i in range(len(near)):
                near[i, first[at + i] : last[at + i]] = -np.inf
            mark = np.partition(near, n - k, axis=1)[:, n - k] if n > k else np.full(len(near), -np.inf)
            rows, cols = np.nonzero((near >= (mark - slack)[:, None]) & (near > -np.inf))
            if unknown is not None and (mark == -np.inf).any():
                for i in np.flatnonzero(mark == -np.inf):
                    unknown[i, first[at + i] : last[at + i]] = False
                    some = np.flatnonzero(unknown[i])[:k]
                    rows, cols = np.append(rows, np.full(len(some), i)), np.append(cols, some)
            rows = rows + at
            distance = rounded(1 - _in_order(queries, vectors, rows, cols) / (a[rows] * b[cols]), places)
            best = np.lexsort((cols, distance, rows))
            place = every_place(rows[best])
            best = best[place < k]
            yield rows[best], cols[best], distance[best]


def every_place(groups: np.ndarray) -> np.ndarray:
    """Of sorted groups, each row's place in its own: 0, 1, ..."""
    if not len(groups):
        return np.zeros(0, np.int64)
    start = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    return np.arange(len(groups)) - np.repeat(start, np.diff(np.append(start, len(groups))))


def _lengths(column: pa.Array) -> np.ndarray:
    """Components of each vector; -1 where it or one of them is null."""
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    if pc.list_flatten(column).null_count:
        broken = pc.unique(pc.list_parent_indices(column).filter(pc.is_null(pc.list_flatten(column)))).to_numpy()
        size[broken] = -1
    return size


def _matrix(column: pa.Array, rows: np.ndarray, d: int) -> np.ndarray:
    return pc.list_flatten(column.take(pa.array(rows))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), d)


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def nearest(queries: DataFrame, vectors: DataFrame, k: int, places: int = 6) -> DataFrame:
    """queries(query, v), vectors(doc, v), ids long and without nulls -> (query, doc, score): of each query the k rows of the
    least distance, rounded to `places`, and further rows; a row with the query's id is none of its own. Both are
    read several times."""
    rows, asked = (x.agg(F.count(F.lit(1)), F.max(F.size("v"))).first() for x in (vectors, queries))
    widest = max(1, rows[1] or 0, asked[1] or 0)
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    down = max(1, -(-asked[0] * widest // CELL))
    across = max(1, -(-rows[0] * widest // CELL), min(4 * cores, rows[0] // 1024))
    dealt = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("long")
    sent = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = queries.select("query", "v", dealt(down).alias("down")).select("*", sent(across).alias("across"))
    v = vectors.select("doc", "v", dealt(across).alias("across")).select("*", sent(down).alias("down"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("doc")
        asked, own = _one(left["v"]), left["query"].to_numpy()
        there, ids = _one(right["v"]), right["doc"].to_numpy()
        found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))]
        if len(own) and len(ids):
            widths, sizes = _lengths(asked), _lengths(there)
            for d in np.unique(widths):
                mine, fit = np.flatnonzero(widths == d), np.flatnonzero((sizes == d) & (d >= 0))
                if len(fit):
                    for i, j, s in search(_matrix(asked, mine, d), own[mine], _matrix(there, fit, d), ids[fit], k, places):
                        found.append((own[mine[i]], ids[fit[j]], s, np.zeros(len(i), bool)))
                if len(fit) < len(ids):  # without a distance, least ids first; k + as many as may be the query's own
                    rest = ids[(sizes != d) | (d < 0)]
                    for name in own[mine]:
                        a, b = np.searchsorted(rest, name, "left"), np.searchsorted(rest, name, "right")
                        some = np.concatenate([rest[: min(a, k)], rest[b : b + k]])[:k]
                        found.append((np.full(len(some), name), some, np.zeros(len(some)), np.ones(len(some), bool)))
        query, doc, score, null = (np.concatenate(x) for x in zip(*found))
        return pa.table({"query": pa.array(query, pa.int64()), "doc": pa.array(doc, pa.int64()), "score": pa.array(score, pa.float64(), mask=null)})

    return q.groupBy("down", "across").cogroup(v.groupBy("down", "across")).applyInArrow(cell, "query long, doc long, score double")

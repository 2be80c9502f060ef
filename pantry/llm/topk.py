"""Exact top-k by inner product: columnar branch and bound.

The vectors are cut into cells of at most `query_rows` queries and `block_rows` candidates, each
cell one task's work whatever the size of the table. In a cell the candidates lie dimension by
dimension. Scores grow block by block of dimensions; after each block the mass that is left on
either side bounds what a candidate can still gain or lose (Cauchy-Schwarz), the k-th best lower
bound is the mark, and the candidates whose upper bound is below it are compacted away. What
survives all blocks has its exact score. The best k of each cell meet in a last ranking, which
Spark cuts to k per query before its shuffle.

Components are integers, so scores are exact; where their size could leave the exact range of
doubles, bounds are widened by what sums of doubles can be off, and the candidates that survive get
their scores on Python's integers; a score beyond a long is held at its end.

Every query is sent to each of the rows / `block_rows` columns of cells and every vector to each of the
queries / `query_rows` rows of cells: that is the shuffle of an exact search of all by all, and larger cells
make it smaller, as far as memory goes. Vectors are dealt to cells by a hash of their row number, evenly.

Defined results for odd rows: vectors that are null, or hold null or non-finite components, and
rows without vec_id take no part. Vectors of different length are not compared. Rows with the
query's own vec_id are its own and no candidates of it. Repeated rows are queries and candidates
each for itself. Other columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

EXACT = 2.0**52
LOW, HIGH = -(2**63), 2**63 - 1


def search_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, dims: int = 16):
    """queries(q, d), vectors(n, d), integers -> for each query the candidates (index, score) that
    can be among the best k, ties included."""
    d = queries.shape[1] if queries.ndim == 2 else 0
    whole_queries, whole_vectors = queries, vectors
    size = float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(vectors.astype(float)).max(initial=0)) * max(d, 1)
    error = size * 2.0**-44 if size >= EXACT else 0.0  # what sums of doubles can be off by
    vectors = vectors.astype(np.float64)
    order = np.argsort(-(vectors * vectors).sum(axis=0), kind="stable")  # the heaviest dimensions first
    columns = np.ascontiguousarray(vectors[:, order].T)
    queries = queries[:, order].astype(np.float64)
    cuts = list(range(0, d, dims)) or [0]
    left = [np.sqrt((columns[c + dims :] ** 2).sum(axis=0)) for c in cuts]
    for n, (q, own) in enumerate(zip(queries, query_ids)):
        alive = np.flatnonzero(ids != own)
        score = np.zeros(len(alive))
        whole = len(alive) == len(ids)
        for c, rest in zip(cuts, left):
            block = columns[c : c + dims]
            score = score + q[c : c + dims] @ (block if whole else block[:, alive])
            if len(alive) <= k:
                continue
            slack = rest[alive] * np.sqrt((q[c + dims :] ** 2).sum()) * (1 + 1e-9)
            slack[slack > 0] += 1e-3
            slack += error
            mark = np.partition(score - slack, len(alive) - k)[len(alive) - k]
            stay = score + slack >= mark
            if not stay.all():
                alive, score, whole = alive[stay], score[stay], False
        if error:  # the few that are left, on integers of any size
            u = [int(x) for x in whole_queries[n]]
            score = np.array([max(LOW, min(HIGH, sum(a * int(b) for a, b in zip(u, whole_vectors[i])))) for i in alive], np.int64)
            best = sorted(range(len(alive)), key=lambda i: (-int(score[i]), ids[alive[i]]))[:k]
        else:
            best = np.lexsort((ids[alive], -score))[:k]
        yield [(int(alive[i]), int(score[i])) for i in best]


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, query_rows: int = 1024, block_rows: int = 16_384) -> DataFrame:
    """queries(query_row, query_id, v), vectors(vec_id, v), v being array<long> without nulls ->
    (query_row, query_id, rank, vec_id, score). Both are read from where they are stored."""
    n, m = vectors.count(), queries.count()
    across, down = max(1, -(-n // block_rows)), max(1, -(-m // query_rows))
    q = queries.select("query_row", "query_id", "v", F.size("v").alias("d"), F.pmod(F.xxhash64("query_row"), F.lit(down)).cast("long").alias("down"))
    q = q.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))).alias("across"))
    v = vectors.select("vec_id", "v", F.size("v").alias("d"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(across)).cast("long").alias("across"))
    v = v.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))).alias("down"))
    kinds = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
        return pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy().reshape(n, -1) if n else np.zeros((0, 0), np.int64)

    def cell(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids = right["vec_id"].to_numpy()
            own, names = left["query_row"].to_pylist(), left["query_id"].to_numpy()
            if key[0].as_py() == 0:
                found = ([(int(i), 0) for i in np.argsort(ids, kind="stable") if ids[i] != name][:k] for name in names)
            else:
                found = search_block(matrix(left["v"], left.num_rows), names, matrix(right["v"], right.num_rows), ids, k)
            rows = [(row, int(name), int(ids[i]), score) for row, name, best in zip(own, names, found) for i, score in best]
        return pa.table([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], schema=kinds)

    by = ["d", "down", "across"]
    met = q.groupBy(*by).cogroup(v.groupBy(*by)).applyInArrow(cell, "query_row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_row", "query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """embeddings(vec_id, embedding) -> (vec_id, v): floor(scale * x) of every component."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * F.lit(float(scale))).cast("long")).alias("v")
    )


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stored(quantised(table(spark, sf_dir, "embeddings")), "vectors")
    queries = stored(vectors.where("vec_id % 50 = 0").select(F.monotonically_increasing_id().alias("query_row"), F.col("vec_id").alias("query_id"), "v"), "queries")
    return top_k(queries, vectors).select("query_id", "rank", "vec_id", "score")


OP2_SQL = """
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
        CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

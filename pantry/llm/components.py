"""Connected components by DataFrame operations only.

Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce
and Beyond", 2014): every round is one aggregation for the smallest neighbour of a node, which
Spark combines before its shuffle, and one join, whose hot keys adaptive execution can split. No
adjacency list is ever collected, and the number of rounds grows with the logarithm of the size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: A guard against a fault, not a limit on the work: log2 of any possible number of nodes, squared.
MAX_ROUNDS = 200


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").selectExpr("v AS u", "m AS v").where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.selectExpr("greatest(u, v) AS u", "least(u, v) AS v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    linked = joined.selectExpr("v AS u", "m AS v").union(least.selectExpr("u", "m AS v"))
    return linked.where("u <> v").distinct()


def _summary(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of any one orderable type -> (node, root), root being the smallest node that
    `node` reaches. Edges with a null end and loops link nothing; nodes without an edge to another
    node are not returned. Repeated edges count once."""
    now = stored(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
                 .selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct(), "edges")
    before = _summary(now)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        now = stored(_small_star(_large_star(now)), "edges", now)
        after = _summary(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    # at rest every node points to the root of its component
    return now.selectExpr("u AS node", "v AS root").union(now.select("v", "v")).distinct()

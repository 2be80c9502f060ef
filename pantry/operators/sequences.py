"""Operators over ordered rows: islands of consecutive rows, flags spread over groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], position: str, *same: str) -> DataFrame:
    """Groups rows whose positions follow each other and whose `same` columns agree:
    (keys, same, first, last, n)."""
    by = [*keys, *same]
    number = F.row_number().over(Window.partitionBy(*by).orderBy(position))
    grouped = df.withColumn("_island", F.col(position) - number).groupBy(*by, "_island")
    return grouped.agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count(F.lit(1)).alias("n")).drop("_island")


def spread_flag(df: DataFrame, keys: list[str], position: str, related: str, flag: str, out: str) -> DataFrame:
    """A row that is not `related` to the one before starts a group; `out` says whether any row of
    the group has the flag."""
    order = Window.partitionBy(*keys).orderBy(position)
    starts = F.sum((~F.coalesce(F.col(related), F.lit(False))).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_group", starts).withColumn(out, F.max(flag).over(Window.partitionBy(*keys, "_group"))).drop("_group")

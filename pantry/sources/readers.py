"""Readers of the engine's text formats, each returning a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(sentence), a row per line."""
    return spark.read.text(path).select(F.col("value").alias("sentence"))


def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(token, vec); a header of two numbers is left out."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") > 2)
    return rows.select(F.col("p")[0].alias("token"), F.slice("p", F.lit(2), F.size("p") - 1).cast("array<float>").alias("vec"))


def tag_rules(spark: SparkSession, path: str) -> DataFrame:
    """(old, new, predicate, parameter), one rule per line."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(p.alias("p")).where(F.size("p") >= 3).select(
        F.col("p")[0].alias("old"), F.col("p")[1].alias("new"), F.col("p")[2].alias("predicate"), F.get("p", F.lit(3)).alias("parameter")
    )


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(word, tag): the first category of each word of a JSON object, plain or gzip."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("word", "tags"))
    return whole.where((F.size("tags") > 0) & (F.col("tags")[0] != "")).select("word", F.col("tags")[0].alias("tag"))


def model(spark: SparkSession, path: str) -> DataFrame:
    """(kind, feature, label, weight) of a sequence model in JSON; a key's last bar parts its label off."""
    kind = "struct<state_features: map<string, bigint>, transitions: map<string, bigint>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("m"))
    out = None
    for name, field in (("emission", "state_features"), ("transition", "transitions")):
        part = whole.select(F.lit(name).alias("kind"), F.explode(f"m.{field}").alias("key", "weight"))
        out = part if out is None else out.union(part)
    label = F.substring_index("key", "|", -1)
    return out.select("kind", F.expr("substring(key, 1, length(key) - length(substring_index(key, '|', -1)) - 1)").alias("feature"), label.alias("label"), "weight")


def foods(spark: SparkSession, path: str) -> DataFrame:
    """(fdc_id, data_type, description, category) of a quoted CSV that may hold line breaks."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return rows.select(F.col("fdc_id").cast("long").alias("fdc_id"), "data_type", "description", "category").where("fdc_id IS NOT NULL")


def recipes(spark: SparkSession, path: str) -> DataFrame:
    """(recipe, style, line_no, line) of a JSON object of recipes."""
    kind = "map<string, struct<style: string, lines: array<string>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("recipe", "r"))
    return rows.select("recipe", "r.style", F.posexplode("r.lines").alias("line_no", "line"))


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines after a header line that has a `count`; plain or gzip."""
    rows = spark.read.text(path).where(F.get_json_object("value", "$.count").isNull())
    return rows.select(F.from_json("value", schema).alias("r")).select("r.*")


def write_records(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)

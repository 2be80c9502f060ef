"""A corpus pipeline over `documents`: each stage works on all rows that the one before has kept.

1. quality: documents that the compression classifier rejects go.
2. lines: lines that an earlier document has in an aligned block are taken out of the text.
3. near_duplicates: of each group of documents that pairs at Jaccard 0.8 or more over shingles of five words connect, one stays;
   SimHash with pigeonhole blocks names pairs first, MinHash and a prefix filter the rest, and whole sets decide.
4. benchmark: documents that hold a passage of the benchmark go, however long they are.
5. tokens: what is left is encoded; the ids are the result.

Every stage but the last returns the columns of `documents`, further ones included, whatever their names;
`n_chars` is kept in step with `text`. Each stage is stored and read again, and is deleted when the next one is.

Defined results for odd rows: no stage fails on an empty table, which gives an empty result. A null text is
an empty one to quality and tokens, has no lines, is like other empty texts, and holds no passage. Rows without
doc_id are judged by quality and benchmark as any others; lines and near_duplicates leave them as they are.
Rows that share a doc_id are versions of one document: lines does not compare them with each other, and near_duplicates
drops all of them if one of them goes. Texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pantry.llm import decontaminate, line_dedup, quality, sentencepiece_viterbi, shingle_dedup
from pantry.llm.common import stored, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Labels are learned from the rows of `docs`, held-out ones excepted."""
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`n_chars` of a text that loses lines is its new length."""
    n_lines, n_deleted = "_n_lines_of_the_stage", "_n_deleted_of_the_stage"
    found = line_dedup.dedup_lines(docs, added=(n_lines, n_deleted))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        found = found.withColumn("n_chars", F.when(F.col(n_deleted) > 0, length).otherwise(F.col("n_chars")))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words are compared, five at a time; rows stay as they are."""
    return shingle_dedup.keep_one(docs, shingle_words=5, percent=80, max_bits=4, blocks=7)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Any passage of 13 words of an item, or a whole shorter item, is one too many."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_viterbi.encode_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_documents),
    ("lines", without_repeated_lines),
    ("near_duplicates", one_of_each_group),
    ("benchmark", uncontaminated),
    ("tokens", encoded),
]

#: SQL has neither the trained classifier nor patience diff nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), ()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}", *before)
        before = (docs,)
    return STAGES[-1][1](spark, docs, sf_dir)

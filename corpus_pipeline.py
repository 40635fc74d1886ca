"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written and read again as the next one's
``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oakmill.llm.common import table, whole_text, written
from oakmill.llm.exact_dedup import exact_duplicates
from oakmill.llm.near_dedup import near_duplicates
from oakmill.llm.packing import public_pack
from oakmill.llm.substring_dedup import without_repeats
from oakmill.llm.toxicity import train, without_toxic

#: Chunks in the encoder's table: few, as executors still hold the memory of the stages before.
CHUNKS = 50_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted to the labelled ones among them, scores 0.7 or more go."""
    return without_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of byte-identical texts the row with the largest doc_id stays, once also if it is repeated under that id."""
    left = docs.join(exact_duplicates(docs).where("NOT kept").select("doc_id"), "doc_id", "left_anti")
    return left.withColumn("__digest", F.sha2(whole_text(), 256)).dropDuplicates(["doc_id", "__digest"]).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row with the least doc_id stays."""
    return docs.join(near_duplicates(docs).where("NOT kept").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; all rows stay."""
    return without_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece of each document with its place in a sequence of 2048 tokens."""
    return public_pack(docs, CHUNKS)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: A fitted model, sampled signatures and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

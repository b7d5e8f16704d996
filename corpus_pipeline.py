"""A corpus pipeline of five stages; each works on all that the one before it kept.

toxicity: documents that score 0.7 or more are dropped.  near_dedup: one document of each near-duplicate class stays.
substring_dedup: words of passages of 35 words or more that occur elsewhere are removed.  mixing: documents are put in
the order of the Pfair schedule.  packing: their tokens are packed into sequences, the weights of mixing as each source's
target share of tokens, so that sequences have the mixture that mixing decided; this stage alone returns other columns, a
row for each piece.

Defined results: null texts are never toxic by more than the bias, are no near copies, lose no words, are mixed like others
and pack as their end id alone; empty texts are copies of each other in near_dedup; null doc_ids and sources, repeated rows,
very long texts and extra columns of any name pass through as each operator's module says; of equal texts the least doc_id
stays; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuscle.llm.common import new_path
from corpuscle.llm.mixing import default_weights, mixed
from corpuscle.llm.neardup import without_near_copies
from corpuscle.llm.packing import pack
from corpuscle.llm.substring import removed
from corpuscle.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return removed(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, default_weights(docs)).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("packing", packing),
]
ORACLE_SQL: str | None = None  # a trained model and hashed signatures are not SQL's


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

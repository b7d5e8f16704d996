"""Reciprocal rank fusion, hits, reranking and citations."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import text as T

CONSTANT = 60
POOL = 20


def rrf(rankings: list[DataFrame], top_k: int, constant: int = CONSTANT, digits: int = 5) -> DataFrame:
    """(query_id, id, score, rank) from lists (query_id, id, rank); ties go to the one seen first, list by list."""
    every = None
    for i, r in enumerate(rankings):
        one = r.select("query_id", "id", F.lit(i).alias("_list"), F.col("rank").cast("long").alias("_rank"))
        every = one if every is None else every.unionByName(one)
    summed = every.groupBy("query_id", "id").agg(F.sum(F.lit(1.0) / (constant + F.col("_rank"))).alias("score"), F.min(F.struct("_list", "_rank")).alias("_seen"))
    by = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "_seen")
    ranked = summed.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top_k)
    return ranked.select("query_id", "id", F.round("score", digits).alias("score"), "rank")


def hits(ranked: DataFrame, chunks: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Text and metadata for ranked ids; ids that the corpus does not hold are dropped."""
    return ranked.join(chunks.select("id", *(columns or [c for c in chunks.columns if c not in ("id", "embedding", "corpus_pos")])), "id")


def lexical_overlap(query: Column, text: Column) -> Column:
    """The share of a query's distinct words that a text holds: a reranker without a model."""
    q, t = F.array_distinct(T.words(query)), F.array_distinct(T.words(text))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(0.0)


def model_scorer(load: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> Callable[[Column, Column], Column]:
    """A scorer out of a model: `load` runs once a worker, the model scores batches of (query, text)."""
    held: dict[str, Callable] = {}

    @F.pandas_udf("double")
    def score(q: pd.Series, t: pd.Series) -> pd.Series:
        try:
            if "model" not in held:
                held["model"] = load()
            return pd.Series(held["model"](q.tolist(), t.tolist()), dtype="float64")
        except Exception:  # noqa: BLE001  a model that fails scores nothing, and rerank keeps the order
            return pd.Series([None] * len(q), dtype="float64")

    return score


def rerank(pool: DataFrame, scorer: Callable[[Column, Column], Column] = lexical_overlap, available: bool = True, digits: int = 5) -> DataFrame:
    """Hits (query_id, query, text, rank[, score]) in the scorer's order.

    Without a model, and for queries with a hit that the scorer gives no score (null), the order and scores stay.
    """
    if not available:
        return pool
    new = F.round(scorer(F.col("query"), F.col("text")), digits)
    scored = pool.withColumnRenamed("rank", "_before").withColumn("_new", new)
    failed = F.max(F.col("_new").isNull() | F.isnan("_new")).over(Window.partitionBy("query_id"))
    kept = F.col("score") if "score" in pool.columns else F.lit(None).cast("double")
    marked = scored.withColumn("_failed", failed).withColumn("score", F.when(F.col("_failed"), kept).otherwise(F.col("_new")))
    by = Window.partitionBy("query_id").orderBy(F.desc(F.when(~F.col("_failed"), F.col("_new"))), "_before")
    return marked.withColumn("rank", F.row_number().over(by)).drop("_before", "_new", "_failed")


def citations(found: DataFrame) -> DataFrame:
    """(query_id, context, sources): numbered lines of hits (query_id, rank, source, text), in order."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]（"), "source", F.lit("）"), "text")
    source = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "source", F.lit(" "), "text")
    rows = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"), source.alias("source_line"))))
    grouped = found.groupBy("query_id").agg(rows.alias("rows"))
    return grouped.select("query_id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("context"), F.transform("rows", lambda r: r["source_line"]).alias("sources"))

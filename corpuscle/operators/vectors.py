"""Exact vector ranking for batches of queries, with the filter first or after an over-fetch.

Without candidates a batch of the corpus is multiplied by the matrix of the queries, and returns the best of each query
alone, so nothing of the size of the corpus is shuffled.  Candidates given as pairs are joined to both vectors, and only
those pairs are scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import vectors as V

QUERY_ROWS = 4096  # of queries in one pass
ROWS_AT_ONCE = 2048


def rank(scores: DataFrame, top_n: int, digits: int = 5) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus_pos")
    rounded = scores.withColumn("score", F.round("score", digits))
    return rounded.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top_n)


def _matrix(vectors: pa.Array) -> np.ndarray:
    v = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


def _best(batches, shared, top_n: int, digits: int):
    ids, asked = shared.value
    for batch in batches:
        vectors = batch.column(2)
        fits = np.flatnonzero(np.asarray(vectors.value_lengths().fill_null(-1)) == asked.shape[1])
        for i in range(0, len(fits), ROWS_AT_ONCE):
            some = fits[i : i + ROWS_AT_ONCE]
            place = batch.column(1).take(pa.array(some)).to_numpy(zero_copy_only=False)
            some = some[np.argsort(place, kind="stable")]
            scores = (_matrix(vectors.take(pa.array(some))) @ asked.T).round(digits)
            take = min(top_n, len(some))
            rows = some[np.argsort(-scores, 0, kind="stable")[:take]].T.ravel()
            own = np.sort(-scores, 0, kind="stable")[:take].T.ravel()
            query = np.repeat(np.arange(len(ids)), take)
            yield pa.RecordBatch.from_arrays([pa.array([ids[q] for q in query], pa.int64()), batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(-own + 0.0, pa.float64())], ["query_id", "id", "corpus_pos", "score"])


def rank_batch(queries: DataFrame, corpus: DataFrame, top_n: int, digits: int = 5) -> DataFrame:
    """(query_id, id, corpus_pos, score, rank) of queries (long query_id, embedding), a stated set; QUERY_ROWS of them a pass."""
    spark = corpus.sparkSession
    rows = corpus.select("id", F.col("corpus_pos").cast("long").alias("corpus_pos"), "embedding").filter(F.col("embedding").isNotNull())
    best = spark.createDataFrame([], f"query_id long, id {dict(corpus.dtypes)['id']}, corpus_pos long, score double")
    asked = [(r["query_id"], r["embedding"]) for r in queries.select("query_id", "embedding").filter(F.col("embedding").isNotNull()).collect()]
    for dim in sorted({len(v) for _, v in asked}):
        own = [x for x in asked if len(x[1]) == dim]
        for i in range(0, len(own), QUERY_ROWS):
            some = own[i : i + QUERY_ROWS]
            shared = spark.sparkContext.broadcast(([q for q, _ in some], _matrix(pa.array([v for _, v in some]))))
            best = best.unionByName(rows.mapInArrow(lambda batches, s=shared: _best(batches, s, top_n, digits), best.schema))
    return rank(best, top_n, digits)


def similarities(pairs: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, id, corpus_pos, score) of the given pairs (query_id, id) alone."""
    q = queries.select("query_id", V.unit(F.col("embedding")).alias("_q"))
    c = corpus.select("id", F.col("corpus_pos").cast("long").alias("corpus_pos"), V.unit(F.col("embedding")).alias("_v"))
    return pairs.select("query_id", "id").distinct().join(q, "query_id").join(c, "id").select("query_id", "id", "corpus_pos", V.dot(F.col("_q"), F.col("_v")).alias("score"))


def vector_rank(queries: DataFrame, corpus: DataFrame, top_n: int, candidates: DataFrame | None = None, mode: str = "exact", over: int = 3) -> DataFrame:
    """(query_id, id, corpus_pos, score, rank).

    mode exact: the filter comes first, so a list is short only if candidates are.  mode overfetch: the best over * top_n
    of all are filtered afterwards, so hits can be lost, as in stores that filter late.
    """
    if candidates is None:
        return rank_batch(queries, corpus, top_n)
    if mode == "exact":
        return rank(similarities(candidates, queries, corpus), top_n)
    return rank(rank_batch(queries, corpus, over * top_n).drop("rank").join(candidates, ["query_id", "id"], "left_semi"), top_n)


def segment_merge(ranked: DataFrame, top_n: int) -> DataFrame:
    """One list a query from ranked lists of its segments (query_id, segment, rank, id): first seen first, without repeats.

    Segments after the one at which top_n ids are known add nothing, since ids are taken in order of segment and rank.
    """
    place = F.min(F.struct("segment", "rank")).alias("place")
    first = ranked.groupBy("query_id", "id").agg(place)
    by = Window.partitionBy("query_id").orderBy("place", "id")
    return first.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top_n).select("query_id", "id", "rank")


def query_segments(queries: DataFrame, tokenizer, limit: int = 512, size: int = 480) -> DataFrame:
    """(query_id, segment, tokens): queries of more than `limit` tokens in slices of `size`, others whole."""
    tokens = queries.select("query_id", tokenizer(F.coalesce("text", F.lit(""))).alias("tokens"))
    n = F.size("tokens")
    starts = F.when(n > limit, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).otherwise(F.array(F.lit(0)))
    cut = tokens.select("query_id", "tokens", n.alias("n"), F.explode(starts).alias("segment"))
    return cut.select("query_id", "segment", F.when(F.col("n") > limit, F.slice("tokens", F.col("segment") * size + 1, F.lit(size))).otherwise(F.col("tokens")).alias("tokens"))

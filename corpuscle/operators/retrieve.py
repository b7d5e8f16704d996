"""Hybrid retrieval of a batch of queries as one plan: facets, BM25 and vectors, fusion, reranking, top k."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.operators import bm25, facets, fusion, vectors


class Corpus:
    """Chunks (id, corpus_pos, text, source, file_type, region, city[, embedding]) and their index of postings, built on first use."""

    def __init__(self, chunks: DataFrame, tokenizer=None) -> None:
        self.chunks, self.tokenizer, self._index = chunks, tokenizer or T.words, None

    @property
    def index(self) -> bm25.Index:
        if self._index is None:
            self._index = bm25.build(self.chunks, self.tokenizer).persist()
        return self._index

    def reset(self, chunks: DataFrame | None = None) -> None:
        """After writes: the next use builds a new index."""
        if self._index is not None:
            self._index.unpersist()
        self._index, self.chunks = None, chunks if chunks is not None else self.chunks


def facet_groups(queries: DataFrame, chunks: DataFrame) -> list[tuple[list, DataFrame]]:
    """(query ids, the chunks they may find) for each distinct set of facets: a filter that reaches the scan, and no pairs."""
    if "file_types" not in queries.columns:
        return [([r["query_id"] for r in queries.select("query_id").collect()], chunks)]
    keys = ["file_types", "provinces", "cities"]
    groups: dict = {}
    for r in queries.select("query_id", *keys).collect():  # the queries are a stated set
        groups.setdefault(tuple(None if r[k] is None else tuple(r[k]) for k in keys), []).append(r["query_id"])
    return [(ids, facets.facet_filter(chunks, *(None if x is None else list(x) for x in own))) for own, ids in groups.items()]


def retrieve(queries: DataFrame, corpus: Corpus, top_k: int = 5, scorer: Callable | None = None, mode: str = "exact", pool: int = fusion.POOL, visible: DataFrame | None = None) -> DataFrame:
    """Hits of queries (query_id, text[, embedding][, file_types, provinces, cities]).

    visible: sources that may be shown (without it all, sensitive ones too).  Statistics always cover the whole corpus.
    """
    want = pool if scorer else top_k
    shown = corpus.chunks if visible is None else corpus.chunks.join(visible.select("source"), "source", "left_semi").select(*corpus.chunks.columns)
    groups = facet_groups(queries, shown)
    lists = [bm25.rank_batch(queries, corpus.chunks, 2 * want, tokenizer=corpus.tokenizer, among=groups)]
    if "embedding" in queries.columns:
        every = None
        for ids, some in groups:
            own = queries.select("query_id", "embedding").filter(F.col("query_id").isin(ids)) if len(groups) > 1 else queries.select("query_id", "embedding")
            if mode == "exact":
                found = vectors.rank_batch(own, some, 2 * want)
            else:
                late = vectors.rank_batch(own, corpus.chunks, 3 * 2 * want).drop("rank").join(some.select("id"), "id", "left_semi")
                found = vectors.rank(late, 2 * want)
            every = found if every is None else every.unionByName(found)
        lists.append(every)
    found = fusion.hits(fusion.rrf(lists, want), corpus.chunks)
    if scorer:
        found = fusion.rerank(found.join(queries.select("query_id", F.col("text").alias("query")), "query_id"), scorer).drop("query")
    return found.filter(F.col("rank") <= top_k)


def layers(queries: DataFrame, corpus: Corpus, **options) -> dict[str, DataFrame]:
    """What each layer makes of the queries, to be looked at: hits, and the context that a prompt would get."""
    found = retrieve(queries, corpus, **options)
    return {"hits": found.select("query_id", "rank", "score", "source", F.substring("text", 1, 40).alias("head")), "context": fusion.citations(found)}


def self_test(corpus: Corpus, query: str, embed: Callable | None = None, top_k: int = 3) -> str:
    """'' if a query finds something after a rebuild, else what went wrong; it never raises."""
    spark = corpus.chunks.sparkSession
    asked = spark.createDataFrame([(0, query)], "query_id long, text string")
    if embed:
        asked = asked.withColumn("embedding", embed(F.col("text")))
    found, why = retrieve_or_empty(asked, corpus, top_k=top_k)
    return why or ("" if found.limit(1).count() else "nothing was found")


def retrieve_or_empty(queries: DataFrame, corpus: Corpus, **options) -> tuple[DataFrame, str]:
    """Hits, and '' or why there are none: a failure gives an empty result instead of an error."""
    spark = queries.sparkSession
    try:
        found = retrieve(queries, corpus, **options).persist()
        found.count()
        return found, ""
    except Exception as e:  # noqa: BLE001
        return spark.createDataFrame([], "query_id long, id string, score double, rank int, text string, source string"), str(e).splitlines()[0]

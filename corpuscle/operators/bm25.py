"""Okapi BM25 for batches of queries.  Statistics always cover the whole corpus, whatever candidates a query has.

Two ways to the same scores:
* `build` / `score` / `rank`: an index of four tables.  The queries' terms are joined to postings on the term, so work
  follows the postings of the terms asked for: for few, selective queries and for candidates given as pairs.
* `rank_batch`: two passes over the corpus for many queries, whose words would make most pairs of query and document anyway:
  one for the statistics of all terms, one to rank.  Each batch of documents becomes a matrix of term weights, multiplied
  by the matrices of the queries; a task returns the best top_n of each query, so nothing of the size of the corpus is
  shuffled.  Queries whose matrices pass AT_ONCE_BYTES take another ranking pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import text as T

K1, B, EPSILON = 1.5, 0.75, 0.25


@dataclass
class Index:
    """postings (id, token, tf), lengths (id, corpus_pos, len), terms (token, df, idf), stats (n, mean_len; one row)."""

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    stats: DataFrame
    tokenizer: Callable[[Column], Column]

    def persist(self) -> Index:
        for t in (self.postings, self.lengths, self.terms, self.stats):
            t.persist()
        return self

    def unpersist(self) -> None:
        for t in (self.postings, self.lengths, self.terms, self.stats):
            t.unpersist()


def build(corpus: DataFrame, tokenizer: Callable[[Column], Column] = T.words, epsilon: float = EPSILON) -> Index:
    """corpus: (id, corpus_pos, text)."""
    tokens = corpus.select("id", "corpus_pos", tokenizer(F.coalesce("text", F.lit(""))).alias("tokens"))
    lengths = tokens.select("id", "corpus_pos", F.size("tokens").alias("len"))
    postings = tokens.select("id", F.explode("tokens").alias("token")).groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"))
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean_len"))
    df = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    n = F.col("n").cast("double")
    raw = df.crossJoin(F.broadcast(stats.select("n"))).select("token", "df", (F.ln(n - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))  # one row
    terms = raw.crossJoin(F.broadcast(mean)).select("token", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    return Index(postings, lengths, terms, stats, tokenizer)


def score(queries: DataFrame, index: Index, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, score) of all pairs with a term in common; queries: (query_id, text).  Repeated terms count again."""
    asked = queries.select("query_id", F.explode(index.tokenizer(F.coalesce("text", F.lit("")))).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("times"))
    weighted = asked.join(index.terms.select("token", "idf"), "token")
    hits = index.postings.join(weighted, "token").join(index.lengths.select("id", "len"), "id").crossJoin(F.broadcast(index.stats))
    tf = F.col("tf").cast("double")
    part = F.col("times") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("mean_len")))
    return hits.groupBy("query_id", "id").agg(F.sum(part).alias("score"))


def rank(scores: DataFrame, index: Index, top_n: int, candidates: DataFrame | None = None, digits: int = 5, query_ids: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank, corpus_pos): the best top_n of each query.

    candidates: (query_id, id); without it all of the corpus.  Documents of no score fill up a list in corpus order.
    """
    positions = index.lengths.select("id", "corpus_pos")
    if candidates is not None:
        scored = candidates.join(scores, ["query_id", "id"], "left").join(positions, "id")
    else:
        # all scored documents, and as filler the first documents of the corpus that the query did not score: ranks up to top_n
        # need those among the first top_n, or, where scores can be negative, among the first top_n and as many as are scored
        ids = (query_ids if query_ids is not None else scores).select("query_id").distinct()
        first = F.broadcast(positions.orderBy("corpus_pos").limit(top_n))
        if index.terms.filter("idf < 0").limit(1).count():  # only if the average term is in more than half of the documents
            most = scores.groupBy("query_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
            first = positions.orderBy("corpus_pos").limit(top_n + most)
        filler = ids.crossJoin(first).join(scores.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("score", F.lit(0.0))
        scored = scores.join(positions, "id").unionByName(filler.select("query_id", "id", "score", "corpus_pos"))
    rounded = scored.withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), digits))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus_pos")
    return rounded.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top_n).select("query_id", "id", "score", "rank", "corpus_pos")


def _tokens(corpus: DataFrame, tokenizer) -> Column:
    return F.col("tokens") if "tokens" in corpus.columns else tokenizer(F.coalesce("text", F.lit("")))


QUERIES_AT_ONCE = 256  # of a matrix
AT_ONCE_BYTES = 128 << 20  # of matrices sent to all tasks for one pass
DOCUMENTS_AT_ONCE = 512


def _weights(queries: list, corpus: DataFrame, tokenizer, k1: float, b: float, epsilon: float):
    """(mean length, matrices): one pass of the corpus.  A matrix: (query ids, terms, term by query weights) of QUERIES_AT_ONCE queries."""
    spark = corpus.sparkSession
    asked = spark.createDataFrame([(i, r["text"]) for i, r in enumerate(queries)], "q int, text string")
    asked = asked.select("q", F.explode(tokenizer(F.coalesce("text", F.lit("")))).alias("token")).groupBy("q", "token").agg(F.count(F.lit(1)).alias("times")).collect()
    terms = sorted({r["token"] for r in asked})
    # a row a document without a token carries its length
    tokens = corpus.select(_tokens(corpus, tokenizer).alias("tokens"))
    each = tokens.select(F.size("tokens").alias("len"), F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("tokens"))).alias("token"))
    df = each.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("token").isNull(), F.col("len"))).alias("len"))
    whole = df.filter(F.col("token").isNull()).select(F.col("df").cast("double").alias("n"), (F.col("len") / F.col("df")).alias("mean_len"))
    raw = df.filter(F.col("token").isNotNull()).crossJoin(F.broadcast(whole)).withColumn("raw", F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))  # whole: one row
    own = spark.createDataFrame([(t,) for t in terms], "token string").withColumn("asked", F.lit(True))
    known = raw.join(F.broadcast(own), "token", "left").agg(F.avg("raw").alias("mean"), F.max("mean_len").alias("mean_len"), F.collect_list(F.when(F.col("asked"), F.struct("token", "raw"))).alias("terms")).first()
    idf = {r["token"]: epsilon * known["mean"] if r["raw"] < 0 else r["raw"] for r in known["terms"]}
    out = []
    for i in range(0, len(queries), QUERIES_AT_ONCE):
        some = queries[i : i + QUERIES_AT_ONCE]
        mine = [r for r in asked if i <= r["q"] < i + len(some) and r["token"] in idf]
        here = sorted({r["token"] for r in mine})
        at = {t: k for k, t in enumerate(here)}
        weights = np.zeros((len(here), len(some)))
        for r in mine:
            weights[at[r["token"]], r["q"] - i] = r["times"] * idf[r["token"]] * (k1 + 1)
        out.append(([r["query_id"] for r in some], here, weights))
    return float(known["mean_len"] or 1.0), out


def _best(batches, shared, top_n: int, digits: int, k1: float, b: float):
    """For all batches of (id, corpus_pos, tokens) of a task: the best top_n of each query, documents without a score included."""
    mean, matrices = shared.value
    matrices = [(ids, pa.array(terms, pa.string()), weights) for ids, terms, weights in matrices]
    best = [None] * len(matrices)  # (query, id, corpus_pos, score), at most top_n rows a query
    # memory is that of DOCUMENTS_AT_ONCE documents, whatever batches are
    for batch in (b.slice(i, DOCUMENTS_AT_ONCE) for b in batches for i in range(0, b.num_rows, DOCUMENTS_AT_ONCE)):
        tokens = batch.column(2)
        lengths = np.asarray(tokens.value_lengths().fill_null(0))
        place = batch.column(1).to_numpy(zero_copy_only=False)
        by_place, take = np.argsort(place, kind="stable"), min(top_n, batch.num_rows)
        words = tokens.flatten()
        of = np.repeat(np.arange(batch.num_rows), lengths)
        for m, (ids, terms, weights) in enumerate(matrices):
            found = pc.index_in(words, value_set=terms)
            doc, term = of[np.asarray(found.is_valid())], found.drop_null().to_numpy().astype(np.int64)
            cell, tf = np.unique(doc * max(len(terms), 1) + term, return_counts=True)
            doc, term = cell // max(len(terms), 1), cell % max(len(terms), 1)
            used, column = np.unique(term, return_inverse=True)
            dense = np.zeros((batch.num_rows, len(used)))
            dense[doc, column] = tf / (tf + k1 * (1 - b + b * lengths[doc] / mean))
            scores = (dense @ weights[used]).round(digits)
            rows = by_place[np.argsort(-scores[by_place], 0, kind="stable")[:take]].T.ravel()
            query = np.repeat(np.arange(len(ids)), take)
            some = pa.table({"query": query, "id": batch.column(0).take(pa.array(rows)), "corpus_pos": pa.array(place[rows], pa.int64()), "score": scores[rows, query]})
            if best[m] is not None:
                some = pa.concat_tables([best[m], some])
                order = np.lexsort((some["corpus_pos"].to_numpy(), -some["score"].to_numpy(), some["query"].to_numpy()))
                of_query = some["query"].to_numpy()[order]
                nth = np.arange(len(order)) - np.searchsorted(of_query, of_query)
                some = some.take(pa.array(order[nth < top_n])).combine_chunks()
            best[m] = some
    for (ids, _, _), some in zip(matrices, best, strict=True):
        if some is not None:
            named = pa.array(ids, pa.int64()).take(some["query"].combine_chunks())
            yield from pa.table({"query_id": named, **{c: some[c] for c in ("id", "corpus_pos", "score")}}).combine_chunks().to_batches()


def rank_batch(queries: DataFrame, corpus: DataFrame, top_n: int, where: Column | None = None, tokenizer: Callable[[Column], Column] = T.words, k1: float = K1, b: float = B, epsilon: float = EPSILON, digits: int = 5, among: list[tuple[list, DataFrame]] | None = None) -> DataFrame:
    """(query_id, id, score, rank, corpus_pos), as `rank`.

    The queries (long query_id, text) are a stated set.  `where` restricts what is ranked, not the statistics; `among` does
    so for each of several sets of query ids, by the rows of the corpus that they may find.  A corpus with `tokens` is taken by
    these, not by its text: that is for tokenizers that cost more than to write what they give.
    """
    spark = corpus.sparkSession
    kind = dict(corpus.dtypes)["id"]
    every = queries.select("query_id", "text").collect()
    if among is None:
        among = [([r["query_id"] for r in every], corpus if where is None else corpus.filter(where))]
    group = {q: g for g, (ids, _) in enumerate(among) for q in ids}
    asked = sorted((r for r in every if r["query_id"] in group), key=lambda r: group[r["query_id"]])
    mean, matrices = _weights(asked, corpus, tokenizer, k1, b, epsilon) if asked else (1.0, [])
    best = spark.createDataFrame([], f"query_id long, id {kind}, corpus_pos long, score double")
    for g, (_, some) in enumerate(among):
        rows = some.select("id", F.col("corpus_pos").cast("long").alias("corpus_pos"), _tokens(some, tokenizer).alias("tokens"))
        own = [([q for q in ids if group[q] == g], terms, weights[:, [k for k, q in enumerate(ids) if group[q] == g]]) for ids, terms, weights in matrices]
        own = [m for m in own if m[0]]
        while own:
            pass_, size = [], 0
            while own and (not pass_ or size + own[0][2].nbytes <= AT_ONCE_BYTES):
                size += own[0][2].nbytes
                pass_.append(own.pop(0))
            shared = spark.sparkContext.broadcast((mean, pass_))
            best = best.unionByName(rows.mapInArrow(lambda batches, s=shared: _best(batches, s, top_n, digits, k1, b), best.schema))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus_pos")
    return best.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top_n).select("query_id", "id", "score", "rank", "corpus_pos")

"""Retrieval metrics by kind of query and overall."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def query_metrics(queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(query_id, kind, hit, recall, precision, rr); queries: (query_id, kind, gold array), found: (query_id, rank, source).

    Sources are compared as sets, so a source found twice lowers precision; a query without gold counts with zeros.
    """
    gold = queries.select("query_id", F.explode(F.array_distinct("gold")).alias("source"))
    matched = found.filter(F.col("rank") <= k).join(gold, ["query_id", "source"])
    per = matched.groupBy("query_id").agg(F.countDistinct("source").alias("n"), F.min("rank").alias("first"))
    out = queries.select("query_id", "kind", F.size(F.array_distinct("gold")).alias("wanted")).join(per, "query_id", "left")
    n = F.coalesce("n", F.lit(0)).cast("double")
    return out.select("query_id", "kind", F.when(n > 0, 1.0).otherwise(0.0).alias("hit"), F.when(F.col("wanted") > 0, n / F.col("wanted")).otherwise(0.0).alias("recall"), (n / k).alias("precision"), F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("rr"))


def evaluate(queries: DataFrame, found: DataFrame, k: int = 5, digits: int = 4) -> DataFrame:
    """Means for each kind and for all (kind 'all')."""
    per = query_metrics(queries, found, k)
    means = [F.round(F.avg(c), digits).alias(a) for c, a in (("hit", "hit"), ("recall", "recall"), ("precision", "precision"), ("rr", "mrr"))]
    return per.rollup("kind").agg(F.count(F.lit(1)).alias("n"), *means).withColumn("kind", F.coalesce("kind", F.lit("all")))


def report(metrics: DataFrame, k: int) -> DataFrame:
    """Lines of a text report (place, value), to be appended with mode('append').text."""
    line = F.format_string("%-8s n=%d hit@" + str(k) + "=%.4f recall=%.4f precision=%.4f mrr=%.4f", "kind", "n", "hit", "recall", "precision", "mrr")
    return metrics.select(F.when(F.col("kind") == "all", 0).otherwise(1).alias("place"), line.alias("value")).orderBy("place", "value")


def sample(queries: DataFrame, n: int, seed: int = 42, kind: str | None = None) -> DataFrame:
    """A seeded sample without replacement, by the order of a hash."""
    some = queries.filter(F.col("kind") == kind) if kind else queries
    return some.orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("query_id").cast("string"))), "query_id").limit(n)


PATTERN_BYTES = 16 << 20  # of texts looked for in one pass


def containing(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, source) of documents (source, text) that hold the text of a query (query_id, text) anywhere.

    The queries are a stated set; their texts become an automaton that reads every document once.  Texts of more than
    PATTERN_BYTES in all take another pass.  Blank texts are in no document.
    """
    spark = corpus.sparkSession
    asked = [(r["query_id"], r["text"]) for r in queries.select("query_id", "text").collect() if (r["text"] or "").strip()]
    found = spark.createDataFrame([], f"query_id long, source {dict(corpus.dtypes)['source']}")
    while asked:
        some, size = [], 0
        while asked and (not some or size + len(asked[0][1]) <= PATTERN_BYTES):
            size += len(asked[0][1])
            some.append(asked.pop(0))
        shared = spark.sparkContext.broadcast(some)

        def run(batches, shared=shared):
            import ahocorasick

            known: dict[str, list] = {}
            for q, text in shared.value:
                known.setdefault(text, []).append(q)
            automaton = ahocorasick.Automaton()
            for text, ids in known.items():
                automaton.add_word(text, (text, ids))
            automaton.make_automaton()
            for batch in batches:
                ids, rows = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    held = {w: own for _, (w, own) in automaton.iter(text or "")}
                    mine = [q for own in held.values() for q in own]
                    ids += mine
                    rows += [i] * len(mine)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column(0).take(pa.array(rows, pa.int64()))], ["query_id", "source"])

        found = found.unionByName(corpus.select("source", "text").mapInArrow(run, found.schema))
    return found


def latency(timed: DataFrame) -> DataFrame:
    """(n, mean_ms) of timed queries (query_id, ms)."""
    return timed.agg(F.count("ms").alias("n"), F.coalesce(F.round(F.avg("ms"), 3), F.lit(0.0)).alias("mean_ms"))


def kinds(queries: DataFrame, long: int = 500) -> DataFrame:
    """(kind, n, long): queries of each kind, and how many have `long` characters or more."""
    return queries.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("text") >= long).alias("long"))

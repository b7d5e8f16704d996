"""Queries on segmented words and on stored indexes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import segment
from corpuscle.functions import text as T
from corpuscle.operators import bm25, inverted, sketches, vector_index
from corpuscle.operators.blocks import written
from corpuscle.plans import tables
from corpuscle.plans.retrieval import BM25_SQL, vector_tables
from corpuscle.plans.retrieval import ORACLE_SQL as VECTOR_SQL
from corpuscle.plans.tables import FILES_SQL
from corpuscle.sources.files import load
from corpuscle.sources.keyed import KeyedTable
from corpuscle.sources.store import new_folder

TOP = 10
WORDS = 100_000  # of the dictionary of segmented_queries, as its SQL has it
LETTER = r"\p{L}"


def _squeezed(text) -> F.Column:
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit("")))


def _counts(spark: SparkSession, sf_dir: str):
    return segment.learnt(tables.corpus(spark, sf_dir).select("text"), T.words)


def _tokenizer(spark: SparkSession, words: segment.Trie | segment.Slices):
    """Texts without blanks to words of a dictionary."""
    cut = segment.segmenter(words, spark, letters=LETTER)
    return lambda text: cut(_squeezed(text))


def segmented_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts without their blanks, in the WORDS most frequent words of the documents."""
    most = _counts(spark, sf_dir).orderBy(F.desc("count"), "word").limit(WORDS)
    words = _tokenizer(spark, segment.trie(most))(F.col("text"))
    rows = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.posexplode(words).alias("place", "word"))
    return rows.select("query_id", "place", "word")


def segmented_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their blanks, in words: the dictionary is all words of the documents."""
    words = _tokenizer(spark, segment.stored(_counts(spark, sf_dir)))(F.col("text"))
    rows = tables.corpus(spark, sf_dir).select("id", words.alias("words"))
    return rows.select("id", F.size("words").alias("n"), F.md5(F.array_join("words", " ")).alias("md5"))


def bm25_segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 where neither queries nor documents have blanks."""
    cut = _tokenizer(spark, segment.stored(_counts(spark, sf_dir)))
    # both passes of the ranking read words that were cut once
    docs = written(tables.corpus(spark, sf_dir).select("id", "corpus_pos", cut(F.col("text")).alias("tokens")), inverted.BATCH_ROWS)
    found = bm25.rank_batch(tables.queries(spark, sf_dir), docs, TOP, tokenizer=cut)
    return found.select("query_id", "id", "score", "rank")


def _index(spark: SparkSession, sf_dir: str) -> inverted.Inverted:
    index = inverted.Inverted(spark, new_folder(spark, "index"), block=8)
    index.upsert(tables.corpus(spark, sf_dir))
    return index


def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole queries through a stored index."""
    return _index(spark, sf_dir).search(tables.queries(spark, sf_dir), TOP).select("query_id", "id", "score", "rank")


def postings_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search by bounds takes apart of the postings of each query's terms."""
    return _index(spark, sf_dir).reading(tables.queries(spark, sf_dir), TOP)


def index_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of old texts, after new texts for the German documents, and without the French ones."""
    docs = tables.corpus(spark, sf_dir, "lang")
    index = inverted.Inverted(spark, new_folder(spark, "index"), block=8)
    index.upsert(docs.withColumn("text", F.when(F.col("lang") == "de", F.concat(F.lit("old text "), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))))
    index.upsert(docs.filter("lang = 'de'"))
    index.delete(docs.filter("lang = 'fr'").select("source"))
    return index.search(tables.queries(spark, sf_dir), TOP).select("query_id", "id", "score", "rank")


def keyed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry of files as a keyed table: failed ones are queued again, sensitive ones leave."""
    files = tables.files(spark, sf_dir).select("filename", "size", "status", "sensitive")
    table = KeyedTable(spark, new_folder(spark, "files"), "filename", 16)
    table.upsert(files)
    table.upsert(files.filter("status = 'failed'").withColumn("status", F.lit("queued")))
    table.delete(files.filter("sensitive"))
    return table.read()


def _cells(spark: SparkSession, sf_dir: str, facet: str | None = None) -> tuple[DataFrame, vector_index.VectorIndex]:
    q, c = vector_tables(spark, sf_dir)
    index = vector_index.VectorIndex(spark, new_folder(spark, "vectors"))
    index.build(c, max(1, round(math.sqrt(c.count()))), facet)
    return q, index


def vector_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors through stored cells, by bounds."""
    q, index = _cells(spark, sf_dir)
    return index.search(q, TOP).select("query_id", "id", "score", "rank")


def vector_cells_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of a query's label through stored cells, of which those without the label are not looked at."""
    q, index = _cells(spark, sf_dir, "label")
    return index.search(q, TOP, facet="label").select("query_id", "id", "score", "rank")


def weekly_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and the median value of each week, out of stored sketches of days; whether they are within their bounds of the exact ones."""
    events = load(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "user_id", "value")
    path = new_folder(spark, "sketches")
    sketches.kept(events, ["day"], F.col("user_id"), F.col("value")).write.parquet(path)
    week = F.date_trunc("week", "day").cast("date").alias("week")
    told = sketches.told(sketches.merged(spark.read.parquet(path).select(week, "n", "distinct_sketch", "quantile_sketch"), ["week"]), [0.5])
    exact = events.select(week, "user_id", "value").join(F.broadcast(told.select("week", F.get("quantiles", F.lit(0)).alias("median"))), "week")  # a row a week
    exact = exact.groupBy("week").agg(F.countDistinct("user_id").alias("users"), (F.count_if(F.col("value") <= F.col("median")) / F.count("value")).alias("rank"))
    near = F.abs(F.col("values") - F.col("users")) <= sketches.DISTINCT_ERROR * F.col("users")
    return told.join(exact, "week").select(F.col("week").cast("string").alias("week"), "n", "users", near.alias("users_near"), (F.abs(F.col("rank") - 0.5) <= sketches.RANK_ERROR + 1 / F.col("n")).alias("median_near"))


QUERIES = {"weekly_sketches": weekly_sketches, "vector_cells": vector_cells, "vector_cells_filtered": vector_cells_filtered, "bm25_postings": bm25_postings, "postings_read": postings_read, "index_deltas": index_deltas, "keyed_files": keyed_files, "segmented_queries": segmented_queries, "segmented_words": segmented_words, "bm25_segmented": bm25_segmented}

# the least cost of every end of a run, from its last letter on, and the words that begin there
_SEGMENTED = r"""WITH RECURSIVE counts AS MATERIALIZED (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS w FROM documents) GROUP BY w ORDER BY n DESC, w LIMIT 100000),
words AS (SELECT w, CAST(round(1000000 * ln((SELECT sum(n) FROM counts) / CAST(n AS DOUBLE))) AS BIGINT) AS cost FROM counts WHERE length(w) <= 63),
lone AS (SELECT CAST(round(1000000 * ln(CAST(sum(n) AS DOUBLE))) AS BIGINT) AS cost FROM counts),
pieces AS (SELECT item_id, unnest(p) AS piece, unnest(range(len(p))) AS nth FROM (SELECT item_id, regexp_extract_all(lower(replace(text, ' ', '')), '\p{L}+|\p{N}+') AS p FROM benchmark)),
runs AS (SELECT DISTINCT piece AS run, length(piece) AS size FROM pieces WHERE regexp_matches(piece, '\p{L}')),
parts AS (SELECT run, size, i, unnest(range(1, least(63, size - i + 1) + 1)) AS n FROM (SELECT run, size, unnest(range(1, size + 1)) AS i FROM runs)),
edges AS MATERIALIZED (SELECT run, size - i + 1 AS rest, n, coalesce(cost, (SELECT cost FROM lone)) AS cost FROM parts LEFT JOIN words ON w = substr(run, i, n) WHERE cost IS NOT NULL OR n = 1),
dp AS (SELECT run, size, CAST(0 AS BIGINT) AS rest, [CAST(0 AS BIGINT)] AS best, CAST([] AS BIGINT[]) AS take FROM runs
  UNION ALL SELECT d.run, any_value(d.size), d.rest + 1, list_append(any_value(d.best), min(e.cost + d.best[d.rest + 2 - e.n])), list_append(any_value(d.take), arg_min(e.n, (e.cost + d.best[d.rest + 2 - e.n]) * 64 + 63 - e.n))
  FROM dp d JOIN edges e ON e.run = d.run AND e.rest = d.rest + 1 GROUP BY d.run, d.rest),
done AS MATERIALIZED (SELECT run, size, take FROM dp WHERE rest = size),
path AS (SELECT run, size, take, CAST(1 AS BIGINT) AS i, take[size] AS n, 0 AS nth FROM done
  UNION ALL SELECT run, size, take, i + n, take[size - (i + n) + 1], nth + 1 FROM path WHERE i + n <= size),
whole AS (SELECT item_id, nth, 0 AS part, piece AS word FROM pieces WHERE NOT regexp_matches(piece, '\p{L}')
  UNION ALL SELECT item_id, pieces.nth, path.nth, substr(run, i, n) FROM pieces JOIN path ON run = piece)
SELECT item_id AS query_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY nth, part) - 1 AS INT) AS place, word FROM whole"""

_LEFT = BM25_SQL.replace("FROM documents)", "FROM documents WHERE lang IS NULL OR lang <> 'fr')")

ORACLE_SQL = {
    "segmented_queries": _SEGMENTED,
    "bm25_postings": f"WITH {BM25_SQL} SELECT query_id, id, score, rank FROM ranked WHERE rank <= {TOP}",
    "index_deltas": f"WITH {_LEFT} SELECT query_id, id, score, rank FROM ranked WHERE rank <= {TOP}",
    "weekly_sketches": "SELECT CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS week, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_near, true AS median_near FROM events GROUP BY 1",
    "vector_cells": VECTOR_SQL["vector_topk"], "vector_cells_filtered": VECTOR_SQL["vector_filtered_exact"],
    "keyed_files": f"SELECT filename, size, CASE WHEN status = 'failed' THEN 'queued' ELSE status END AS status, sensitive FROM ({FILES_SQL}) WHERE NOT sensitive",
}

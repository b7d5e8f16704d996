"""The driver's tables as the engine's: corpus, registry, queries, log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.sources.files import load

# the same derivations in SQL, for oracles
FACETS = """CASE lang WHEN 'en' THEN '国家法律' WHEN 'fr' THEN '行政法规' ELSE '地方法规' END AS file_type,
  CASE lang WHEN 'en' THEN '' WHEN 'fr' THEN '' ELSE source END AS region,
  CASE WHEN lang IN ('de','es') AND doc_id % 3 = 0 THEN concat('c', CAST(doc_id % 5 AS varchar)) ELSE '' END AS city"""
CORPUS_SQL = f"SELECT doc_id AS id, doc_id AS corpus_pos, text, concat('doc', CAST(doc_id AS varchar), '.txt') AS source, {FACETS} FROM documents"
FILES_SQL = f"""SELECT concat('doc', CAST(d.doc_id AS varchar), '.txt') AS filename, d.doc_id, md5(text) AS md5, {FACETS.replace('doc_id', 'd.doc_id')}, CAST(strlen(text) AS BIGINT) AS size,
  CASE quality WHEN 1 THEN 'ready' WHEN 0 THEN 'failed' ELSE 'building' END AS status, coalesce(toxic, 0) = 1 AS sensitive
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def _facets() -> list:
    lang, doc = F.col("lang"), F.col("doc_id")
    kind = F.when(lang == "en", "国家法律").when(lang == "fr", "行政法规").otherwise("地方法规")
    region = F.when(lang.isin("en", "fr"), "").otherwise(F.col("source"))
    city = F.when(lang.isin("de", "es") & (doc % 3 == 0), F.concat(F.lit("c"), (doc % 5).cast("string"))).otherwise("")
    return [kind.alias("file_type"), region.alias("region"), city.alias("city")]


def filename():
    return F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt"))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows of fewer partitions than there are cores are dealt out by key; larger inputs stay as they are read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows


def corpus(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """(id, corpus_pos, text, source, file_type, region, city) and more columns of documents"""
    return spread(_corpus(spark, sf_dir, *more), "id")


def _corpus(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("corpus_pos"), "text", filename().alias("source"), *_facets(), *more)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    # what texts give is taken before the join, which then moves no texts
    own = load(spark, sf_dir, "documents").select(filename().alias("filename"), "doc_id", F.md5("text").alias("md5"), *_facets(), F.octet_length("text").cast("long").alias("size"))
    status = F.when(F.col("quality") == 1, "ready").when(F.col("quality") == 0, "failed").otherwise("building")
    return own.join(labels, "doc_id", "left").select("filename", "doc_id", "md5", "file_type", "region", "city", "size", status.alias("status"), (F.coalesce("toxic", F.lit(0)) == 1).alias("sensitive"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text, kind) of benchmark."""
    kind = F.element_at(F.array(F.lit("short"), F.lit("news"), F.lit("long")), (F.col("item_id") % 3 + 1).cast("int"))
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", kind.alias("kind"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("username"), F.col("event_type").alias("action"), F.col("props").alias("target"), (F.col("event_type") != "error").cast("int").alias("success"))


LOG_SQL = "SELECT event_id AS id, ts, concat('user', CAST(user_id AS varchar)) AS username, event_type AS action, props AS target, CAST(event_type <> 'error' AS INT) AS success FROM events"

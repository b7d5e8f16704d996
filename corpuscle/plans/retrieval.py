"""Retrieval queries over documents, benchmark and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.operators import blocks, bm25, embed, evaluate, facets, fusion, retrieve, vectors
from corpuscle.plans import tables
from corpuscle.plans.tables import CORPUS_SQL, FILES_SQL
from corpuscle.sources.files import load

TOP = 10
FACET = (["国家法律", "地方法规"], ["src1", "src3", "src5"], ["c1", "c2"])


def _ranked(spark: SparkSession, sf_dir: str, top: int) -> DataFrame:
    return bm25.rank_batch(tables.queries(spark, sf_dir), tables.corpus(spark, sf_dir), top)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, TOP).select("query_id", "id", "score", "rank")


def bm25_candidates_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = facets.facet_predicate(F.col("file_type"), F.col("region"), F.col("city"), *map(facets.literal_list, FACET))
    return bm25.rank_batch(tables.queries(spark, sf_dir), tables.corpus(spark, sf_dir), TOP, where).select("query_id", "id", "score", "rank")


def _facet(types, provinces, cities):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return facets.facet_filter(tables.corpus(spark, sf_dir), types, provinces, cities).select("id", "file_type", "region", "city")

    return run


VECTORS = 50  # of the vectors, those whose id it divides are queries


def vector_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = load(spark, sf_dir, "embeddings")
    q = rows.filter(F.col("vec_id") % VECTORS == 0).select(F.col("vec_id").alias("query_id"), "embedding", "label")
    return q, rows.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("corpus_pos"), "embedding", "label")


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c = vector_tables(spark, sf_dir)
    return vectors.vector_rank(q, c, TOP).select("query_id", "id", "score", "rank")


def vector_filtered_overfetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c = vector_tables(spark, sf_dir)
    same = q.select("query_id", "label").join(c.select("id", "label"), "label").select("query_id", "id")
    return vectors.vector_rank(q, c, TOP, same, mode="overfetch").select("query_id", "id", "score", "rank")


def vector_filtered_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of a query's label: blocks of queries meet blocks of vectors of their label."""
    q, c = vector_tables(spark, sf_dir)
    found = blocks.best(blocks.blocks(c, ["label"], blocks.VECTORS), q, ["label"], TOP)
    return vectors.rank(found, TOP).select("query_id", "id", "score", "rank")


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    words = _ranked(spark, sf_dir, 2 * TOP)
    vq, vc = vector_tables(spark, sf_dir)
    return words, vectors.vector_rank(vq, vc, 2 * TOP)


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rrf(list(_lists(spark, sf_dir)), TOP)


def hybrid_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fusion.hits(rrf_fusion(spark, sf_dir), tables.corpus(spark, sf_dir))
    return found.select("query_id", "id", "score", "rank", "source", "file_type", F.length("text").alias("n_chars"))


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = tables.queries(spark, sf_dir)
    pool = fusion.hits(_ranked(spark, sf_dir, fusion.POOL).drop("corpus_pos"), tables.corpus(spark, sf_dir), ["text", "source"])
    return pool.join(q.select("query_id", F.col("text").alias("query")), "query_id")


def rerank_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rerank(_pool(spark, sf_dir)).filter(F.col("rank") <= 5).select("query_id", "id", "score", "rank")


def rerank_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scorer that fails on every other query: those keep their order and scores."""
    scorer = lambda q, t: F.when(F.length(q) % 2 == 1, fusion.lexical_overlap(q, t))
    return fusion.rerank(_pool(spark, sf_dir), scorer).select("query_id", "id", "score", "rank")


def _faceted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with facets of their own: none, two types, or a type that must be in a place."""
    kind = F.col("kind")
    lists = {"file_types": F.when(kind == "news", facets.literal_list(FACET[0])).when(kind == "long", facets.literal_list(["地方法规"])), "provinces": F.when(kind == "long", facets.literal_list(FACET[1])), "cities": F.when(kind == "long", facets.literal_list([]))}
    return tables.queries(spark, sf_dir).select("query_id", "text", *[c.alias(n) for n, c in lists.items()])


def retrieve_faceted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of queries with facets, where sensitive sources may not be shown."""
    shown = tables.files(spark, sf_dir).filter("NOT sensitive").select(F.col("filename").alias("source"))
    found = retrieve.retrieve(_faceted(spark, sf_dir), retrieve.Corpus(tables.corpus(spark, sf_dir)), 5, visible=shown)
    return found.select("query_id", "id", "score", "rank", "source")


def embedded_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all documents by the encoder without a model, a row a number."""
    rows = load(spark, sf_dir, "documents").select("doc_id", embed.embedder()(F.col("text")).alias("v"))
    return rows.select("doc_id", F.posexplode("v").alias("n", "x")).select("doc_id", "n", F.round("x", 5).alias("x"))


def query_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.kinds(tables.queries(spark, sf_dir))


def mean_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.latency(load(spark, sf_dir, "events").select(F.col("event_id").alias("query_id"), (F.col("value") * 10).alias("ms")))


def merged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of segments as one list a query: each order's parts, first seen first."""
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("segment"), (F.col("l_suppkey") % 3).alias("rank"), (F.col("l_partkey") % 4).alias("id"))
    return vectors.segment_merge(lines, 3)


def citation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = fusion.hits(bm25_topk(spark, sf_dir).filter("rank <= 3"), tables.corpus(spark, sf_dir), ["text", "source"])
    return fusion.citations(top).select("query_id", "context", F.array_join("sources", "\n\n").alias("sources"))


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with the documents that hold their text."""
    q = tables.queries(spark, sf_dir)
    held = evaluate.containing(tables.corpus(spark, sf_dir), q)
    gold = held.groupBy("query_id").agg(F.array_sort(F.collect_list("source")).alias("gold"))
    return q.join(gold, "query_id", "left").withColumn("gold", F.coalesce("gold", F.array().cast("array<string>")))


def _found(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    top = bm25_topk(spark, sf_dir).filter(F.col("rank") <= k)
    return top.join(tables.corpus(spark, sf_dir).select("id", "source"), "id").select("query_id", "rank", "source")


def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = evaluate.query_metrics(_gold(spark, sf_dir), _found(spark, sf_dir, 5), 5)
    return per.select("query_id", "kind", *[F.round(c, 5).alias(c) for c in ("hit", "recall", "precision", "rr")])


def eval_metrics_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.evaluate(_gold(spark, sf_dir), _found(spark, sf_dir, 5), 5)


def embedding_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each query vector's ten nearest others that have its label."""
    q, c = vector_tables(spark, sf_dir)
    ranked = vectors.vector_rank(q, c, TOP + 1).join(c.select("id", F.col("label").alias("found")), "id").join(q.select("query_id", "label"), "query_id").filter("id != query_id")
    return ranked.groupBy("query_id").agg(F.round(F.avg((F.col("label") == F.col("found")).cast("double")), 5).alias("precision"))


def query_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.corpus(spark, sf_dir).select(F.col("id").alias("query_id"), "text")
    cut = vectors.query_segments(docs, T.words)
    return cut.select("query_id", "segment", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("body"))


def token_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and idf of all terms."""
    index = bm25.build(tables.corpus(spark, sf_dir))
    return index.terms.select("token", "df", F.round("idf", 5).alias("idf"))


QUERIES = {
    "bm25_topk": bm25_topk, "bm25_candidates_filtered": bm25_candidates_filtered,
    "facet_none": _facet(None, None, None), "facet_empty_types": _facet([], FACET[1], None), "facet_places": _facet(None, FACET[1], FACET[2]), "facet_types": _facet(["行政法规"], None, None), "facet_types_places": _facet(*FACET),
    "vector_topk": vector_topk, "vector_filtered_overfetch": vector_filtered_overfetch, "vector_filtered_exact": vector_filtered_exact, "rrf_fusion": rrf_fusion, "hybrid_hits": hybrid_hits,
    "rerank_lexical": rerank_lexical, "citation_context": citation_context, "eval_metrics": eval_metrics, "eval_metrics_rollup": eval_metrics_rollup, "embedding_eval": embedding_eval, "query_segments": query_segments, "token_statistics": token_statistics,
    "rerank_fallback": rerank_fallback, "retrieve_faceted": retrieve_faceted, "embedded_letters": embedded_letters, "query_kinds": query_kinds, "mean_latency": mean_latency, "merged_segments": merged_segments,
}

BM25_SQL = f"""corpus AS ({CORPUS_SQL}),
tok AS MATERIALIZED (SELECT id, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS token FROM corpus),
tf AS MATERIALIZED (SELECT id, token, count(*) AS tf FROM tok GROUP BY ALL),
len AS (SELECT c.id, corpus_pos, coalesce(n, 0) AS len FROM corpus c LEFT JOIN (SELECT id, count(*) AS n FROM tok GROUP BY id) t ON c.id = t.id),
st AS (SELECT count(*) AS n, avg(len) AS m FROM len),
raw AS (SELECT token, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT token, count(*) AS df FROM tf GROUP BY token), st),
terms AS (SELECT token, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
bench AS (SELECT item_id AS query_id, text, ['short', 'news', 'long'][item_id % 3 + 1] AS kind FROM benchmark),
q AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS token FROM bench) GROUP BY ALL),
sc AS (SELECT query_id, tf.id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / m))) AS score FROM q JOIN terms USING (token) JOIN tf USING (token) JOIN len ON len.id = tf.id, st GROUP BY ALL),
ranked AS (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_pos) AS INT) AS rank FROM (
  SELECT b.query_id, l.id, l.corpus_pos, round(coalesce(score, 0), 5) AS score FROM bench b CROSS JOIN len l LEFT JOIN sc ON sc.query_id = b.query_id AND sc.id = l.id))"""
_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"
_VEC = f"""vec AS (SELECT a.vec_id AS query_id, b.vec_id AS id, a.label AS ql, b.label AS cl, round({_COS}, 5) AS score FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % {VECTORS} = 0),
vranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM vec)"""
_FUSED = f"""{BM25_SQL}, {_VEC},
lists AS (SELECT 0 AS l, query_id, id, rank FROM ranked WHERE rank <= {2 * TOP} UNION ALL SELECT 1, query_id, id, rank FROM vranked WHERE rank <= {2 * TOP}),
summed AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS s, min(l * 1000 + rank) AS seen FROM lists GROUP BY ALL),
fused AS (SELECT query_id, id, round(s, 5) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, seen) AS INT) AS rank FROM summed)"""
_GOLD = "gold AS (SELECT b.query_id, c.source FROM bench b JOIN corpus c ON contains(c.text, b.text))"
_PER = f"""{BM25_SQL}, {_GOLD},
fnd AS (SELECT query_id, rank, source FROM ranked JOIN corpus USING (id) WHERE rank <= 5),
m AS (SELECT query_id, count(DISTINCT source) AS n, min(rank) AS first FROM fnd JOIN gold USING (query_id, source) GROUP BY query_id),
w AS (SELECT query_id, count(*) AS wanted FROM gold GROUP BY query_id),
per AS (SELECT b.query_id, kind, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0 END AS hit, coalesce(n::DOUBLE / wanted, 0) AS recall, coalesce(n, 0)::DOUBLE / 5 AS precision, coalesce(1.0::DOUBLE / first, 0) AS rr FROM bench b LEFT JOIN m USING (query_id) LEFT JOIN w USING (query_id))"""
_IN_TYPES = "file_type IN ('国家法律', '地方法规')"
_IN_PLACE = "(file_type = '国家法律' OR CASE WHEN city <> '' THEN city IN ('c1', 'c2') ELSE region IN ('src1', 'src3', 'src5') END)"
_FACET_ROWS = f"SELECT id, file_type, region, city FROM ({CORPUS_SQL}) WHERE "

ORACLE_SQL = {
    "bm25_topk": f"WITH {BM25_SQL} SELECT query_id, id, score, rank FROM ranked WHERE rank <= {TOP}",
    "bm25_candidates_filtered": f"WITH {BM25_SQL} SELECT query_id, id, score, CAST(r AS INT) AS rank FROM (SELECT ranked.query_id, ranked.id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_pos) AS r FROM ranked JOIN corpus USING (id) WHERE {_IN_TYPES} AND {_IN_PLACE}) WHERE r <= {TOP}",
    "facet_none": _FACET_ROWS + "true", "facet_empty_types": _FACET_ROWS + "false", "facet_places": _FACET_ROWS + _IN_PLACE, "facet_types": _FACET_ROWS + "file_type = '行政法规'", "facet_types_places": _FACET_ROWS + f"{_IN_TYPES} AND {_IN_PLACE}",
    "vector_topk": f"WITH {_VEC} SELECT query_id, id, score, rank FROM vranked WHERE rank <= {TOP}",
    "vector_filtered_overfetch": f"WITH {_VEC} SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM vranked WHERE rank <= {3 * TOP} AND ql = cl QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {TOP}",
    "vector_filtered_exact": f"WITH {_VEC} SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM vec WHERE ql = cl QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {TOP}",
    "rrf_fusion": f"WITH {_FUSED} SELECT query_id, id, score, rank FROM fused WHERE rank <= {TOP}",
    "hybrid_hits": f"WITH {_FUSED} SELECT query_id, id, score, rank, source, file_type, CAST(length(text) AS INT) AS n_chars FROM fused JOIN corpus USING (id) WHERE rank <= {TOP}",
    "rerank_lexical": f"""WITH {BM25_SQL}, pool AS (SELECT r.query_id, r.id, r.rank AS before, round(len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), '\\p{{L}}+')), regexp_extract_all(lower(c.text), '\\p{{L}}+')))::DOUBLE / len(list_distinct(regexp_extract_all(lower(b.text), '\\p{{L}}+'))), 5) AS score
  FROM ranked r JOIN bench b USING (query_id) JOIN corpus c ON c.id = r.id WHERE r.rank <= 20)
SELECT query_id, id, score, CAST(n AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS n FROM pool) WHERE n <= 5""",
    "rerank_fallback": f"""WITH {BM25_SQL}, pool AS (SELECT r.query_id, r.id, r.rank AS before, r.score AS old, length(b.text) % 2 = 0 AS failed, round(len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), '\\p{{L}}+')), regexp_extract_all(lower(c.text), '\\p{{L}}+')))::DOUBLE / len(list_distinct(regexp_extract_all(lower(b.text), '\\p{{L}}+'))), 5) AS new
  FROM ranked r JOIN bench b USING (query_id) JOIN corpus c ON c.id = r.id WHERE r.rank <= 20)
SELECT query_id, id, CASE WHEN failed THEN old ELSE new END AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN failed THEN 0 ELSE new END DESC, before) AS INT) AS rank FROM pool""",
    "retrieve_faceted": f"""WITH {BM25_SQL}, fl AS ({FILES_SQL}), own AS (SELECT r.query_id, r.id, c.source, row_number() OVER (PARTITION BY r.query_id ORDER BY r.score DESC, c.corpus_pos) AS n FROM ranked r JOIN corpus c ON c.id = r.id JOIN bench b ON b.query_id = r.query_id JOIN fl ON fl.filename = c.source
  WHERE NOT sensitive AND CASE b.kind WHEN 'short' THEN true WHEN 'news' THEN c.{_IN_TYPES} ELSE c.file_type = '地方法规' AND CASE WHEN c.city <> '' THEN false ELSE c.region IN ('src1', 'src3', 'src5') END END)
SELECT query_id, id, round(1.0::DOUBLE / (60 + n), 5) AS score, CAST(n AS INT) AS rank, source FROM own WHERE n <= 5""",
    "embedded_letters": """WITH t AS (SELECT doc_id, substr(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), 1, 510) AS s FROM documents),
c AS (SELECT doc_id, n, length(s) - length(replace(s, chr(CAST(97 + n AS INT)), '')) AS k FROM t, range(26) r(n))
SELECT doc_id, CAST(n AS INT) AS n, round(k / CASE WHEN sum(k * k) OVER (PARTITION BY doc_id) = 0 THEN 1 ELSE sqrt(sum(k * k) OVER (PARTITION BY doc_id)) END, 5) AS x FROM c""",
    "query_kinds": "SELECT ['short', 'news', 'long'][item_id % 3 + 1] AS kind, count(*) AS n, count(*) FILTER (length(text) >= 500) AS long FROM benchmark GROUP BY 1",
    "mean_latency": "SELECT count(value) AS n, round(avg(value * 10), 3) AS mean_ms FROM events",
    "merged_segments": "WITH f AS (SELECT l_orderkey AS query_id, l_partkey % 4 AS id, min(l_linenumber * 10 + l_suppkey % 3) AS place FROM lineitem GROUP BY ALL) SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place, id) AS INT) AS rank FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY place, id) <= 3",
    "citation_context": f"""WITH {BM25_SQL} SELECT query_id, string_agg(concat('[', CAST(rank AS varchar), ']（', source, '）', text), chr(10) ORDER BY rank) AS context, string_agg(concat('[', CAST(rank AS varchar), '] ', source, ' ', text), chr(10) || chr(10) ORDER BY rank) AS sources FROM ranked JOIN corpus USING (id) WHERE rank <= 3 GROUP BY query_id""",
    "eval_metrics": f"WITH {_PER} SELECT query_id, kind, round(hit, 5) AS hit, round(recall, 5) AS recall, round(precision, 5) AS precision, round(rr, 5) AS rr FROM per",
    "eval_metrics_rollup": f"WITH {_PER} SELECT coalesce(kind, 'all') AS kind, count(*) AS n, round(avg(hit), 4) AS hit, round(avg(recall), 4) AS recall, round(avg(precision), 4) AS precision, round(avg(rr), 4) AS mrr FROM per GROUP BY ROLLUP (kind)",
    "embedding_eval": f"WITH {_VEC} SELECT query_id, round(avg(CAST(ql = cl AS DOUBLE)), 5) AS precision FROM vranked WHERE rank <= {TOP + 1} AND id <> query_id GROUP BY query_id",
    "query_segments": """WITH t AS (SELECT doc_id AS query_id, regexp_extract_all(lower(text), '\\p{L}+') AS tokens FROM documents),
s AS (SELECT query_id, tokens, unnest(CASE WHEN len(tokens) > 512 THEN range(0, CAST(floor((len(tokens) - 1) / 480) AS INT) + 1) ELSE [0] END) AS segment FROM t),
c AS (SELECT query_id, CAST(segment AS INT) AS segment, CASE WHEN len(tokens) > 512 THEN list_slice(tokens, segment * 480 + 1, segment * 480 + 480) ELSE tokens END AS own FROM s)
SELECT query_id, segment, CAST(len(own) AS INT) AS n, array_to_string(own, ' ') AS body FROM c""",
    "token_statistics": """WITH tok AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '\\p{L}+'))) AS token FROM documents),
raw AS MATERIALIZED (SELECT token, count(*) AS df, ln((SELECT count(*) FROM documents) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tok GROUP BY token)
SELECT token, df, round(CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END, 5) AS idf FROM raw""",
}

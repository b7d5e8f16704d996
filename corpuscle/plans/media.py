"""Array arithmetic of image models and texts for chat models, on sizes and positions made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import kernels
from corpuscle.operators import chat
from corpuscle.sources.files import load

FACTOR, LEAST, MOST = 28, 3136, 200_704


def fitted_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 37 + 1).alias("h"), (F.col("p_partkey") % 900 + 1).alias("w"))
    return rows.select("p_partkey", kernels.fitted_size(F.col("h"), F.col("w"), FACTOR, LEAST, MOST).alias("s")).select("p_partkey", F.coalesce("s.height", F.lit(0)).alias("height"), F.coalesce("s.width", F.lit(0)).alias("width"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    grids = load(spark, sf_dir, "nation").select(k.alias("image"), (k % 2 + 1).cast("int").alias("t"), (k % 3 * 2 + 2).cast("int").alias("h"), (k % 4 * 2 + 2).cast("int").alias("w"))
    return kernels.grid_tokens(grids, 2)


def grid_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).select("image", F.col("token").cast("int").alias("token"), "row", "col")


def grid_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kernels.bilinear(_tokens(spark, sf_dir), 48)
    four = [x for k in range(4) for x in (F.col("indices")[k].alias(f"i{k}"), F.round(F.col("weights")[k].cast("double"), 4).alias(f"w{k}"))]
    return rows.select("image", F.col("token").cast("int").alias("token"), *four)


def rope_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of sequences of text and images: an order is a sequence, its every third line an image."""
    image = F.col("l_linenumber") % 3 == 0
    side = lambda c: F.when(image, (F.col(c) % 3 * 2 + 2).cast("int"))
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    rows = lines.select(F.col("l_orderkey").alias("seq"), F.col("l_linenumber").cast("int").alias("segment"), (F.col("l_partkey") % 5).cast("int").alias("length"), F.when(image, 1).alias("grid_t"), side("l_suppkey").alias("grid_h"), side("l_partkey").alias("grid_w"))
    return kernels.rope_positions(rows, 2)


def expanded_pads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders as runs; where their number is not that of the sizes there is no text."""
    k = F.col("c_custkey")
    sizes = F.when(k % 7 == 0, F.array(k % 3)).otherwise(F.array(k % 3, k % 5))
    ids = kernels.expand_pads(F.array(F.lit(1), F.lit(9), k, F.lit(9), F.lit(3)), sizes, 9)
    return load(spark, sf_dir, "customer").filter("c_custkey <> 9").select("c_custkey", F.coalesce(F.array_join(ids.cast("array<string>"), ","), F.lit("-")).alias("ids"))


def chat_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as the marked text that a chat model reads."""
    return chat.chat_texts(load(spark, sf_dir, "conversations")).select("conv_id", F.md5("text").alias("text"))


def substituted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts whose @name.txt is replaced by that file's text, and the first other @name as their medium."""
    docs = load(spark, sf_dir, "documents")
    files = docs.filter("doc_id % 2 = 0").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), "text")
    asked = F.concat(F.lit("read  @doc"), F.col("doc_id").cast("string"), F.lit(".txt\n@a"), F.col("doc_id").cast("string"), F.lit(".png @b.png and say"))
    out = chat.substitute_paths(docs.select(F.col("doc_id").alias("id"), asked.alias("prompt")), files)
    return out.select("id", F.md5("prompt").alias("prompt"), "media", "ignored")


def assembled_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut into tokens of three bytes, and put together as far as they are whole characters."""
    rows = load(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("stream"), F.col("text").cast("binary").alias("raw"))
    n = F.greatest(F.octet_length("raw"), F.lit(1))
    cut = rows.select("stream", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 3).cast("int")), lambda i: F.substring("raw", i * 3 + 1, F.lit(3)))).alias("n", "token"))
    return chat.assemble(cut).select("stream", F.md5(F.array_join("words", "")).alias("text"), F.exists("words", lambda x: x.contains("�")).alias("broken"))


QUERIES = {f.__name__: f for f in (fitted_sizes, grid_positions, grid_neighbours, rope_positions, expanded_pads, chat_prompts, substituted_paths, assembled_words)}

_GRID = """g AS (SELECT n_nationkey AS image, n_nationkey % 2 + 1 AS t, n_nationkey % 3 * 2 + 2 AS h, n_nationkey % 4 * 2 + 2 AS w FROM nation),
k AS (SELECT *, unnest(range(t * h * w)) AS token FROM g),
p AS (SELECT image, h, w, token, token // t % 4 AS inside, token // t // 4 AS block FROM k),
x AS (SELECT image, h, w, CAST(token AS INT) AS token, CAST(block // (w // 2) * 2 + inside // 2 AS INT) AS row, CAST(block % (w // 2) * 2 + inside % 2 AS INT) AS col FROM p)"""
ORACLE_SQL = {
    "fitted_sizes": f"""WITH a AS (SELECT p_partkey, (p_size * 37 + 1)::DOUBLE AS h, (p_partkey % 900 + 1)::DOUBLE AS w FROM part),
b AS (SELECT *, round_even(h / {FACTOR}, 0) * {FACTOR} AS nh, round_even(w / {FACTOR}, 0) * {FACTOR} AS nw, sqrt(h * w / {MOST}) AS s, sqrt({LEAST} / (h * w)) AS g FROM a)
SELECT p_partkey, CAST(CASE WHEN greatest(h, w) / least(h, w) > 200 THEN 0 WHEN nh * nw > {MOST} THEN greatest({FACTOR}, floor(h / s / {FACTOR}) * {FACTOR}) WHEN nh * nw < {LEAST} THEN ceil(h * g / {FACTOR}) * {FACTOR} ELSE nh END AS INT) AS height,
  CAST(CASE WHEN greatest(h, w) / least(h, w) > 200 THEN 0 WHEN nh * nw > {MOST} THEN greatest({FACTOR}, floor(w / s / {FACTOR}) * {FACTOR}) WHEN nh * nw < {LEAST} THEN ceil(w * g / {FACTOR}) * {FACTOR} ELSE nw END AS INT) AS width FROM b""",
    "grid_positions": f"WITH {_GRID} SELECT image, token, row, col FROM x",
    "grid_neighbours": f"""WITH {_GRID}, y AS (SELECT *, CASE WHEN h > 1 THEN row * 47.0::DOUBLE / (h - 1) ELSE 0 END AS r, CASE WHEN w > 1 THEN col * 47.0::DOUBLE / (w - 1) ELSE 0 END AS c FROM x),
z AS (SELECT image, token, floor(r) AS r0, least(floor(r) + 1, 47) AS r1, r - floor(r) AS dr, floor(c) AS c0, least(floor(c) + 1, 47) AS c1, c - floor(c) AS dc FROM y)
SELECT image, token, CAST(r0 * 48 + c0 AS INT) AS i0, round((1 - dr) * (1 - dc), 4) AS w0, CAST(r0 * 48 + c1 AS INT) AS i1, round((1 - dr) * dc, 4) AS w1, CAST(r1 * 48 + c0 AS INT) AS i2, round(dr * (1 - dc), 4) AS w2, CAST(r1 * 48 + c1 AS INT) AS i3, round(dr * dc, 4) AS w3 FROM z""",
    "rope_positions": """WITH s AS (SELECT l_orderkey AS seq, CAST(l_linenumber AS INT) AS segment, min(l_partkey) % 5 AS length, l_linenumber % 3 = 0 AS image, min(l_suppkey) % 3 + 1 AS gh, min(l_partkey) % 3 + 1 AS gw FROM lineitem GROUP BY l_orderkey, l_linenumber),
b AS (SELECT *, coalesce(sum(CASE WHEN image THEN greatest(1, gh, gw) ELSE length END) OVER (PARTITION BY seq ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s),
e AS (SELECT *, unnest(range(CASE WHEN image THEN gh * gw ELSE length END)) AS k FROM b)
SELECT seq, segment, CAST(k AS INT) AS k, CAST(start + CASE WHEN image THEN k // (gh * gw) ELSE k END AS INT) AS t, CAST(start + CASE WHEN image THEN k // gw % gh ELSE k END AS INT) AS h, CAST(start + CASE WHEN image THEN k % gw ELSE k END AS INT) AS w FROM e""",
    "expanded_pads": "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '-' ELSE '1,' || repeat('9,', CAST(greatest(c_custkey % 3, 1) AS INT)) || c_custkey || ',' || repeat('9,', CAST(greatest(c_custkey % 5, 1) AS INT)) || '3' END AS ids FROM customer WHERE c_custkey <> 9",
    "chat_prompts": "SELECT conv_id, md5(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10)) AS text FROM conversations GROUP BY conv_id",
    "substituted_paths": "SELECT doc_id AS id, md5('read ' || CASE WHEN doc_id % 2 = 0 THEN text ELSE '@doc' || doc_id || '.txt' END || ' and say') AS prompt, 'a' || doc_id || '.png' AS media, 1 AS ignored FROM documents",
    "assembled_words": "SELECT conv_id || '/' || turn AS stream, md5(text) AS text, false AS broken FROM conversations",
}

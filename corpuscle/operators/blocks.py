"""Scores of queries against vectors by blocks: rows of many vectors that agree in some keys are joined on the keys.

A block of queries meets a block of vectors in one row, which becomes one product of matrices and returns the best of each
query.  No pair of a query and a vector is ever a row, neither side is collected or broadcast, and what a key holds is spread
over as many rows as it needs, so that skewed keys can be split.
"""

from __future__ import annotations

import contextlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.sources.store import new_folder

VECTORS = 512  # of a block
QUERIES = 128
ROWS_AT_ONCE = 32  # pairs of blocks in an Arrow batch: some 200 kB each at 64 dimensions
SALTS = 8  # tasks that the queries of a key are dealt out to


def unit(flat: np.ndarray, width: int) -> np.ndarray:
    v = flat.astype(np.float64).reshape(-1, width) if width else np.zeros((0, 0))
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


def _schema(rows: DataFrame, keys: list[str]) -> str:
    kinds = dict(rows.dtypes)
    return ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"ids array<{kinds['id']}>", "positions array<long>", "vectors array<float>", "width int"])


def blocks(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, ids, positions, vectors, width) of rows (keys, id, corpus_pos, embedding): those of a batch that agree in keys and width, end to end.

    Vectors that are null, empty or hold nulls are left out.
    """
    schema = _schema(rows, keys)
    names = [*keys, "ids", "positions", "vectors", "width"]

    def run(given):
        for batch in given:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table.append_column("_width", pa.array(np.asarray(table["embedding"].combine_chunks().value_lengths()), pa.int32()))
            table = table.sort_by([(k, "ascending") for k in [*keys, "_width"]]).combine_chunks()
            by = [table[k].to_pylist() for k in [*keys, "_width"]]
            at, n = 0, table.num_rows
            out = []
            key = list(zip(*by, strict=True))
            while at < n:
                end = at + 1
                while end < n and end - at < size and key[end] == key[at]:
                    end += 1
                part = table.slice(at, end - at)
                out.append((*key[at][:-1], part["id"].to_pylist(), part["corpus_pos"].to_pylist(), part["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False), key[at][-1]))
                at = end
            fields = [table.schema.field(k).type for k in keys]
            kinds = [*fields, pa.list_(table.schema.field("id").type), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    whole = rows.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", F.isnull))
    return whole.select(*keys, "id", F.col("corpus_pos").cast("long").alias("corpus_pos"), F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(run, schema)


def query_blocks(queries: DataFrame, keys: list[str]) -> DataFrame:
    """blocks of queries (keys, query_id, embedding), those of a key together in a few tasks."""
    salt = F.pmod(F.xxhash64("query_id"), F.lit(SALTS))
    together = queries.repartition(*[F.col(k) for k in keys], salt).sortWithinPartitions(*keys) if keys else queries
    made = blocks(together.select(*keys, F.col("query_id").alias("id"), F.lit(0).alias("corpus_pos"), "embedding"), keys, QUERIES)
    return made.select(*keys, F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"), "width")


def best(vector_blocks: DataFrame, queries: DataFrame, keys: list[str], top_n: int, digits: int = 5) -> DataFrame:
    """(query_id, id, corpus_pos, score): of each pair of blocks that agree in keys, the best top_n of each query; written once."""
    on = [*keys, "width"]
    pairs = vector_blocks.join(query_blocks(queries, keys), on).select("query_ids", "query_vectors", "ids", "positions", "vectors", "width")
    kinds = dict(pairs.dtypes)
    schema = f"query_id {kinds['query_ids'][6:-1]}, id {kinds['ids'][6:-1]}, corpus_pos long, score double"

    def run(given):
        for batch in given:
            for i in range(batch.num_rows):
                asked, asked_v, ids, places, own, width = (batch.column(k).slice(i, 1) for k in range(6))
                width = width[0].as_py()
                place = places.flatten().to_numpy(zero_copy_only=False)
                order = np.argsort(place, kind="stable")
                q = unit(asked_v.flatten().to_numpy(zero_copy_only=False), width)
                v = unit(own.flatten().to_numpy(zero_copy_only=False), width)[order]
                scores = (v @ q.T).round(digits) + 0.0
                take = min(top_n, len(v))
                rows = np.argsort(-scores, 0, kind="stable")[:take].T.ravel()
                of = np.repeat(np.arange(len(q)), take)
                yield pa.RecordBatch.from_arrays([asked.flatten().take(pa.array(of)), ids.flatten().take(pa.array(order[rows])), pa.array(place[order[rows]], pa.int64()), pa.array(scores[rows, of])], ["query_id", "id", "corpus_pos", "score"])

    return written(pairs.mapInArrow(run, schema), ROWS_AT_ONCE)


@contextlib.contextmanager
def batches(spark, rows: int):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df as a table in the shared folder; rows: of an Arrow batch while it is written."""
    spark = df.sparkSession
    path = new_folder(spark, "blocks")
    with batches(spark, rows) if rows else contextlib.nullcontext():
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

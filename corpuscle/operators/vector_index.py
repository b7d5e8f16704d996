"""A stored vector index: learnt cells, vectors in blocks by cell, searches that read some cells and can prove that these do.

Cells are the Voronoi cells of centroids that spherical k-means finds on a bounded sample; every vector is put into the cell of
its nearest centroid.  Stored are, as parts of one version:
* `blocks`: (cell, facet, ids, positions, vectors, width), in ranges and in the order of cells, so a scan for some cells skips others;
* `cells`: (cell, facet, n, radius), how many vectors of a facet a cell holds, and how far its farthest is from the centroid.

A search first reads the nearest cells, as many as asked for and so many more as it takes to meet top_n vectors of the query's
facet.  mode "probe" ends there.  mode "exact" goes on: by the triangle inequality no vector of a cell is nearer than the
centroid's distance less the radius; cells in which that might beat the k-th best so far are read too, and the
result is that of comparing all vectors.

Defined results: vectors that are null, empty, of another width than the index or hold nulls are in no cell, and such
queries find nothing; zero vectors have the score 0; a null facet is a facet; of equal scores (five digits) the lesser
corpus_pos is first; an empty index finds nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.operators import blocks as K
from corpuscle.operators.vectors import rank
from corpuscle.sources.store import Store

SAMPLE_PER_CELL = 64  # vectors that k-means sees: so many times the cells, SAMPLE_MOST at most
SAMPLE_MOST = 200_000
ROUNDS = 10
PROBES = 4
MOST_NAMES = 10_000  # cells that are named to the scan
DIGITS = 5

CELLS = "cell int, facet string, n long, radius double"


def learnt(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Unit centroids by spherical k-means; a cell that loses all vectors starts anew at the one that fits worst."""
    v = K.unit(sample, sample.shape[1])
    rng = np.random.default_rng(seed)
    c = v[rng.permutation(len(v))[:cells]].copy()
    for _ in range(rounds):
        score = v @ c.T
        of = score.argmax(1)
        worst = iter(np.argsort(score.max(1), kind="stable"))
        sums = np.zeros_like(c)
        np.add.at(sums, of, v)
        for k in np.flatnonzero(np.bincount(of, minlength=len(c)) == 0):
            sums[k] = v[next(worst)]
        c = K.unit(sums, c.shape[1])
    return c


def _facet(df: DataFrame, column: str | None):
    """Facets as strings, of which a null is one."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null")) if column else F.lit("")


class VectorIndex:
    """An index in a folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.store = Store(spark, path)

    def build(self, corpus: DataFrame, cells: int, facet: str | None = None, seed: int = 1) -> int:
        """A version of corpus (id, corpus_pos, embedding[, facet column]); facet: the column that queries are restricted by."""
        spark = self.store.spark
        rows = corpus.select("id", "corpus_pos", F.col("embedding").cast("array<float>").alias("embedding"), _facet(corpus, facet).alias("facet"))
        whole = rows.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", F.isnull))
        widths = whole.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
        width = widths[0]["w"] if widths else 0
        whole = whole.filter(F.size("embedding") == width)
        most = min(cells * SAMPLE_PER_CELL, SAMPLE_MOST)
        # those of the least hashes: a sample that is the same every time
        some = whole.orderBy(F.xxhash64("id", "embedding"), "id").select("embedding").limit(most).collect()
        centroids = learnt(np.array([r[0] for r in some], np.float64), cells, seed=seed) if some else np.zeros((0, width))
        shared = spark.sparkContext.broadcast(centroids)

        def assign(batches):
            for batch in batches:
                v = K.unit(batch.column(2).flatten().to_numpy(zero_copy_only=False), shared.value.shape[1])
                cell = (v @ shared.value.T).argmax(1) if len(v) else np.zeros(0, np.int64)
                far = np.sqrt(((v - shared.value[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far)], ["id", "corpus_pos", "embedding", "facet", "cell", "far"])

        id_type = dict(rows.dtypes)["id"]
        placed = whole.select("id", F.col("corpus_pos").cast("long").alias("corpus_pos"), "embedding", "facet").mapInArrow(assign, f"id {id_type}, corpus_pos long, embedding array<float>, facet string, cell int, far double")
        staged = self.store.write(placed, "_staged")
        placed = self.store.load([staged], placed.schema)
        in_order = placed.repartitionByRange("cell", "facet", "corpus_pos").sortWithinPartitions("cell", "facet", "corpus_pos")
        made = K.blocks(in_order, ["cell", "facet"], K.VECTORS)
        manifest = {"width": width, "blocks_schema": made.schema.jsonValue(), "centroids": self.store.write(spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>"), "centroids")}
        manifest["blocks"] = self.store.write(made, "blocks")
        # far is rounded up: a radius must hold for all
        manifest["cells"] = self.store.write(placed.groupBy("cell", "facet").agg(F.count(F.lit(1)).alias("n"), (F.max("far") + 1e-9).alias("radius")), "cells")
        version = self.store.publish(manifest, self.store.read()["version"])
        self.store._fs.delete(self.store._fs_path(f"{self.store.path}/{staged}"), True)
        return version

    def _nearest(self, m: dict, queries: DataFrame, facet: str | None) -> DataFrame:
        """(query_id, facet, embedding, cell, n, before, place, bound) for each cell with vectors of the query's facet, nearest first."""
        spark = self.store.spark
        centroids = self.store.load([m["centroids"]], "cell int, centroid array<double>").orderBy("cell").collect()
        shared = spark.sparkContext.broadcast(np.array([r["centroid"] for r in centroids]))
        kind = dict(queries.dtypes)["query_id"]
        asked = queries.select("query_id", _facet(queries, facet).alias("facet"), F.col("embedding").cast("array<float>").alias("embedding"))
        asked = asked.filter((F.size("embedding") == m["width"]) & ~F.exists("embedding", F.isnull))

        def run(batches):
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    some = batch.slice(i, 256)
                    q = K.unit(some.column(1).flatten().to_numpy(zero_copy_only=False), shared.value.shape[1])
                    apart = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (shared.value**2).sum(1)[None] - 2 * q @ shared.value.T, 0))
                    n, k = apart.shape
                    yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(np.arange(k), n), pa.int32()), pa.array(apart.ravel())], ["query_id", "cell", "apart"])

        apart = asked.select("query_id", "embedding").mapInArrow(run, f"query_id {kind}, cell int, apart double")
        cells = self.store.load([m["cells"]], CELLS)
        near = asked.select("query_id", "facet").join(apart, "query_id").join(cells, ["cell", "facet"])
        by = Window.partitionBy("query_id").orderBy("apart", "cell")
        reach = F.greatest(F.col("apart") - F.col("radius") - 1e-7, F.lit(0.0))
        placed = near.withColumn("place", F.row_number().over(by)).withColumn("before", F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        return placed.select("query_id", "facet", "cell", "n", "before", "place", (1 - reach * reach / 2).alias("bound"))

    def _read(self, m: dict, pairs: DataFrame, queries: DataFrame, facet: str | None, top_n: int) -> DataFrame:
        """(query_id, id, corpus_pos, score) in the cells of pairs (query_id, facet, cell)."""
        from pyspark.sql.types import StructType

        made = self.store.load([m["blocks"]], StructType.fromJson(m["blocks_schema"]))
        names = [r[0] for r in pairs.select("cell").distinct().limit(MOST_NAMES + 1).collect()]
        if len(names) <= MOST_NAMES:
            made = made.filter(F.col("cell").isin(names))
        asked = pairs.select("query_id", "facet", "cell").join(queries.select("query_id", "embedding"), "query_id")
        return K.best(made, asked, ["cell", "facet"], top_n, DIGITS)

    def _first(self, near: DataFrame, probes: int, top_n: int) -> DataFrame:
        return near.filter((F.col("place") <= probes) | (F.col("before") < top_n))

    def search(self, queries: DataFrame, top_n: int, facet: str | None = None, probes: int = PROBES, mode: str = "exact", version: int | None = None) -> DataFrame:
        """(query_id, id, corpus_pos, score, rank) of queries (query_id, embedding[, facet column]) with query_ids of their own."""
        m = self.store.read(version)
        near = K.written(self._nearest(m, queries, facet))
        found = self._read(m, self._first(near, probes, top_n), queries, facet, top_n)
        if mode == "exact":
            more = K.written(self._more(near, found, probes, top_n))
            found = found.unionByName(self._read(m, more, queries, facet, top_n))
        return rank(found, top_n, DIGITS)

    def _more(self, near: DataFrame, found: DataFrame, probes: int, top_n: int) -> DataFrame:
        """The cells beside the first ones that may hold one of the best top_n."""
        by = Window.partitionBy("query_id").orderBy(F.desc("score"))
        least = found.withColumn("n", F.row_number().over(by)).filter(F.col("n") == top_n).select("query_id", F.col("score").alias("least"))
        rest = near.filter((F.col("place") > probes) & (F.col("before") >= top_n))
        return rest.join(least, "query_id", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 10.0**-DIGITS))

    def reading(self, queries: DataFrame, top_n: int, facet: str | None = None, probes: int = PROBES, mode: str = "exact", version: int | None = None) -> DataFrame:
        """(query_id, cells, cells_read, vectors, vectors_read): of the cells with vectors of a query's facet, those that a search reads."""
        m = self.store.read(version)
        near = K.written(self._nearest(m, queries, facet))
        read = self._first(near, probes, top_n).select("query_id", "cell")
        if mode == "exact":
            found = self._read(m, self._first(near, probes, top_n), queries, facet, top_n)
            read = read.unionByName(self._more(near, found, probes, top_n).select("query_id", "cell"))
        marked = near.join(read.withColumn("read", F.lit(1)), ["query_id", "cell"], "left")
        return marked.groupBy("query_id").agg(F.count(F.lit(1)).alias("cells"), F.count("read").alias("cells_read"), F.sum("n").alias("vectors"), F.coalesce(F.sum(F.when(F.col("read") == 1, F.col("n"))), F.lit(0)).alias("vectors_read"))

"""Centroid clustering of vectors of whole numbers, with the bounds of Yinyang k-means.

The first centroids are put into groups once, by a few rounds of k-means over the centroids themselves.  Of every vector are
kept: its centroid, an upper bound of the distance to it, and for each group a lower bound of the distance to all other
centroids of the group.  When centroids have moved, the upper bound grows by how far the own one moved, a group's lower bound
falls by how far its farthest-moved one did.  Then
* the global filter leaves a vector where it is if its upper bound, made exact if need be, is below all lower bounds;
* the group filter leaves out every group whose lower bound is above the distance to the own centroid;
* the centroids of the groups that are left are compared exactly.
Distances are exact integers; bounds are floats with room for rounding, and only a bound that is strictly farther leaves
anything out, so every tie is compared and goes to the smaller number: the result is that of comparing all.

A round is one pass over a table of vectors with their bounds, written as the next round's input.  Centroids (k x d numbers)
go to the tasks with it.  Sums of the clusters are kept on the driver (k x d exact integers) and only changed by the vectors
that moved, which partitions add up before anything is shuffled: no cluster's rows ever meet.

Defined results: vectors that are null, of another length, or hold null or non-finite components take no part, and neither
do those with a component beyond 2**27 / scale, whose squared distances are no longs; a null vec_id takes part, and is the
last to start a centroid; repeated rows count as often as they are there, each can start a centroid, of equal hashes the
lesser vector first; fewer vectors than centroids leave as many centroids as vectors; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm.common import materialize, trimmed

DIMENSIONS = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
GROUPS = 4  # of centroids
GROUPING_ROUNDS = 5
MOST = 1 << 27  # of a component, so that squared distances are longs
SEED = 1
_ROOM = 1e-9  # relative, for rounding of bounds

STATE = "vec_id long, v array<int>, cluster int, before int, upper double, lower array<double>"


def whole_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): vectors that take part, in whole numbers."""
    e = F.col("embedding").cast("array<double>")
    v = F.transform(e, lambda x: F.floor(x * scale))
    fine = F.forall(e, lambda x: F.coalesce(F.abs(x) < MOST / scale, F.lit(False)))  # not of nulls, and neither of NaN, which is the largest
    return vectors.filter((F.size(e) == dimensions) & fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<int>").alias("v"))


def first_centroids(whole: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = whole.withColumn("h", h).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in rows], np.int64)


def grouped(centroids: np.ndarray, groups: int = GROUPS, rounds: int = GROUPING_ROUNDS) -> np.ndarray:
    """The group of each centroid."""
    c = centroids.astype(np.float64)
    means = c[np.linspace(0, len(c) - 1, min(groups, len(c))).astype(int)] if len(c) else c
    of = np.zeros(len(c), np.int64)
    for _ in range(rounds if len(c) else 0):
        of = ((c[:, None] - means[None]) ** 2).sum(2).argmin(1)
        means = np.stack([c[of == g].mean(0) if (of == g).any() else means[g] for g in range(len(means))])
    return np.unique(of, return_inverse=True)[1]  # without empty groups


def squared(v: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    d = v - centroid
    return np.einsum("ij,ij->i", d, d)


def _parts(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    """Columns as arrays; those of lists with a row for each row."""
    out = []
    for name in names:
        c = batch.column(batch.schema.get_field_index(name))
        out.append(c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False))
    return out


def nearest(v: np.ndarray, centroids: np.ndarray, group: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector with new bounds, and how many distances were computed.

    cluster: -1 where none is known yet; upper, lower: bounds for these centroids.
    """
    n, groups = len(v), int(group.max(initial=-1)) + 1
    cluster, upper, lower = cluster.astype(np.int64), upper.copy(), lower.copy()
    best = np.full(n, np.iinfo(np.int64).max)
    work = 0
    loose = np.flatnonzero((cluster < 0) | (lower.min(1) <= upper))  # the global filter
    known = loose[cluster[loose] >= 0]
    best[known] = squared(v[known], centroids[cluster[known]])
    upper[known] = np.sqrt(best[known]) * (1 + _ROOM)
    work += len(known)
    left = loose[(cluster[loose] < 0) | (lower[loose].min(1) <= upper[loose])]
    old, old_best = cluster.copy(), best.copy()
    first = lower.copy()  # as they were: an old centroid's group may come before the one that takes its place
    seconds = np.full((n, groups), np.inf)
    scanned = np.zeros((n, groups), bool)
    # only the groups whose bound reaches the distance to the own centroid
    for g in range(groups):
        rows = left[(old[left] < 0) | (first[left, g] <= upper[left])]
        scanned[rows, g] = True
        for c in np.flatnonzero(group == g).tolist():
            at = rows[old[rows] != c]
            if not len(at):
                continue
            d = squared(v[at], centroids[c])
            work += len(at)
            wins = (d < best[at]) | ((d == best[at]) & (c < cluster[at]))
            won, lost = at[wins], at[~wins]
            gone = won[cluster[won] >= 0]  # a centroid that gives way is one of the others of its group
            np.minimum.at(seconds, (gone, group[cluster[gone]]), np.sqrt(best[gone]))
            seconds[lost, g] = np.minimum(seconds[lost, g], np.sqrt(d[~wins]))
            best[won], cluster[won] = d[wins], c
    lower[scanned] = seconds[scanned]
    moved = left[(old[left] >= 0) & (old[left] != cluster[left])]
    lower[moved, group[old[moved]]] = np.minimum(lower[moved, group[old[moved]]], np.sqrt(old_best[moved]))
    lower[left] *= 1 - _ROOM
    upper[left] = np.sqrt(best[left]) * (1 + _ROOM)
    return cluster, upper, lower, work


def assigned(state: DataFrame, centroids: np.ndarray, group: np.ndarray, drift: np.ndarray) -> DataFrame:
    """state with every vector at the nearest of `centroids`, each of which has moved by `drift` since."""
    groups = int(group.max(initial=-1)) + 1
    farthest = np.array([drift[group == g].max() for g in range(groups)])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v, cluster, upper, lower = _parts(batch, ["v", "cluster", "upper", "lower"])
            v = v.astype(np.int64)
            upper = (upper + np.where(cluster >= 0, drift[np.maximum(cluster, 0)], 0)) * (1 + _ROOM)
            lower = (lower - farthest) * (1 - np.sign(lower - farthest) * _ROOM) if lower.shape[1] else np.zeros((len(v), groups))
            new, upper, lower, _ = nearest(v, centroids, group, cluster, upper, lower)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, lower.size + 1, groups), pa.int32()), pa.array(lower.ravel()))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("vec_id", "v")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(new, pa.int32()), pa.array(cluster, pa.int32()), pa.array(upper), flat], ["vec_id", "v", "cluster", "before", "upper", "lower"])

    return state.mapInArrow(trimmed(run), STATE)


def changes(state: DataFrame, k: int, dimensions: int) -> list[tuple[int, int, int]]:
    """(cluster, component or -1 for the number of vectors, by how much its sum changes) of the vectors that have moved."""

    def run(batches):
        sums = np.zeros((k, dimensions + 1), np.int64)
        for batch in batches:
            v, cluster, before = _parts(batch, ["v", "cluster", "before"])
            whole = np.column_stack([v.astype(np.int64).reshape(len(cluster), -1), np.ones(len(cluster), np.int64)]) if len(cluster) else np.zeros((0, dimensions + 1), np.int64)
            for c in range(k):
                sums[c] += whole[cluster == c].sum(0) - whole[before == c].sum(0)
        c, i = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(np.where(i == dimensions, -1, i)), pa.array(sums[c, i])], ["cluster", "component", "change"])

    moved = state.filter("cluster != before").select("v", "cluster", "before")
    added = moved.mapInArrow(trimmed(run), "cluster long, component long, change long").groupBy("cluster", "component").agg(F.sum(F.col("change").cast("decimal(38,0)")).alias("change"))
    return [(r["cluster"], r["component"], int(r["change"])) for r in added.collect()]  # k x (d + 1) rows


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, groups: int = GROUPS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """The state after the last assignment, (vec_id, v, cluster, ...), and the final centroids."""
    whole = materialize(whole_vectors(vectors, dimensions, scale), "whole-vectors", 10_000)
    centroids = first_centroids(whole, k, seed)
    k = len(centroids)
    state = whole.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(-1).alias("before"), F.lit(0.0).alias("upper"), F.array().cast("array<double>").alias("lower"))
    if not k:
        return state, centroids
    group = grouped(centroids, groups)
    sums, counts = [[0] * dimensions for _ in range(k)], [0] * k
    drift = np.zeros(k)
    for last in (*[False] * rounds, True):
        state = materialize(assigned(state, centroids, group, drift), "clustered", 10_000)
        if last:
            break
        for c, i, by in changes(state, k, dimensions):
            if i < 0:
                counts[c] += by
            else:
                sums[c][i] += by
        moved = np.array([[s // counts[c] for s in sums[c]] if counts[c] else centroids[c].tolist() for c in range(k)], np.int64)
        drift = np.array([math.sqrt(x) * (1 + _ROOM) for x in squared(moved, centroids).tolist()])
        centroids = moved
    return state, centroids


RESULT = "vec_id long, cluster int, distance long"


def clustered(vectors: DataFrame, **options) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256); options: those of cluster()."""
    state, centroids = cluster(vectors, **options)
    spark = vectors.sparkSession

    def run(batches):
        for batch in batches:
            v, own = _parts(batch, ["v", "cluster"])
            d = squared(v.astype(np.int64), centroids[own]) if len(own) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(d)], ["vec_id", "cluster", "distance"])

    rows = state.select("vec_id", "v", "cluster").mapInArrow(trimmed(run), RESULT)
    total = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    every = sum(total.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    table = spark.createDataFrame([(c, s, every, digests[c]) for c, s in total.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_yinyang_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    """All rounds written out."""
    parts = [
        f"""v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
p AS MATERIALIZED (SELECT rid, unnest(v) AS x, unnest(range(1, {DIMENSIONS + 1})) AS i FROM v),
c0 AS MATERIALIZED (SELECT c, unnest(v) AS x, unnest(range(1, {DIMENSIONS + 1})) AS i FROM (SELECT v, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS c FROM v) WHERE c < {CENTROIDS})"""
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"d{r} AS (SELECT rid, c, CAST(sum((p.x - c{r}.x) * (p.x - c{r}.x)) AS BIGINT) AS d FROM p JOIN c{r} USING (i) GROUP BY rid, c)")
        parts.append(f"a{r} AS MATERIALIZED (SELECT rid, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)")
        if r < ROUNDS:
            # floor of a quotient of integers, exactly
            parts.append(f"s{r} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN p USING (rid) GROUP BY c, i)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{r} LEFT JOIN s{r} USING (c, i))")
    parts.append(f"h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN v USING (rid) JOIN h USING (c)"""


ORACLE = _oracle()

"""Approximate nearest neighbours by cosine: p-stable hashing, probed at several buckets a table.

A vector of length one is projected on `m` normal directions a table; a hash is the floor of (projection + shift) / width,
and the m hashes make a bucket.  A query visits its own bucket and perturbed ones, by one step up or down in some hashes,
in the order of the estimated chance to find a neighbour there (the sum of squared distances to the boundaries crossed).
Vectors of the visited buckets are the candidates; they are scored exactly, and the best of all tables are merged.

The same is done at every size.  Width, m, the number of tables and of probes are fitted: for FIT_QUERIES queries
the true neighbours among all vectors are found by one exact pass, and of all settings of a grid that find RECALL of them the
cheapest is taken, by the share of a sample of FIT_SAMPLE vectors that its buckets make candidates, the rows to index and the
probes to send.  So finer buckets are taken as vectors grow in number or neighbours nearer; where neighbours are hardly nearer
than other vectors, recall has its price and the share is large.  `fit` gives both figures.

All vectors are indexed.  Equal vectors are indexed once, with the six least ids among them, which is all that a list of
five can need.  Buckets are dealt into cells of some BLOCK vectors; a cell that holds more, or is asked for by more than ASKS
queries, is split on both sides.  A query that found fewer than it wants is asked again with half the hashes and the most
probes, and then of all vectors, in blocks.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, as queries or candidates;
vectors of another dimension are no candidates; rows that repeat an id and its vector count once, and a query's own id is
never its candidate; null ids take no part; ties go to the smaller id; very long vectors are vectors; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.llm.common import materialize, mix, rekeyed, whole_groups

K = 5
EVERY = 50
BLOCK, ASKS = 8192, 2048
FIT_QUERIES, FIT_SAMPLE = 100, 1024
RECALL = 0.96
WIDTHS = (1.75, 2.5, 4.0)
HASHES = (1, 2, 4, 6, 8, 10, 12, 16, 20)
TABLES = (1, 2, 4, 8)
PROBES = (1, 2, 4, 8, 16, 32, 64, 128, 256, 512)
ROW, PROBE = 20.0, 1.0  # what indexing a row, and sending a probe, cost in scored vectors


@functools.cache
def templates(m: int, most: int) -> np.ndarray:
    """Sets of perturbations in their expected order, over the 2m (hash, step) pairs sorted by distance (Lv et al. 2007)."""
    j = np.arange(1, m + 1)
    near = j * (j + 1) / (4 * (m + 1) * (m + 2))
    k = np.arange(m, 0, -1)
    far = 1 - k / (m + 1) + k * (k + 1) / (4 * (m + 1) * (m + 2))
    z = np.concatenate([near, far])
    out = [()]
    heap = [(z[0], (0,))] if m else []
    while heap and len(out) < most:
        score, own = heapq.heappop(heap)
        if len({min(i, 2 * m - 1 - i) for i in own}) == len(own):
            out.append(own)
        last = own[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (score - z[last] + z[last + 1], (*own[:-1], last + 1)))
            heapq.heappush(heap, (score + z[last + 1], (*own, last + 1)))
    table = np.zeros((len(out), 2 * m), bool)
    for i, own in enumerate(out):
        table[i, list(own)] = True
    return table


class Hashes:
    """The hash functions of all tables for any dimension; the same everywhere.  Without hashes (m = 0) all vectors are in one bucket."""

    def __init__(self, m: int, probes: int, tables: int, width: float, seed: int = 7) -> None:
        self.m, self.probes, self.tables, self.width, self.seed = m, probes, tables if m else 1, width, seed
        self.sets = templates(m, 2 * probes)
        self.made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _of(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """Directions and shifts; those of the first tables do not depend on the number of tables."""
        if dim not in self.made:
            drawn = [np.random.default_rng([self.seed, dim, self.m, t]) for t in range(self.tables)]
            made = [(r.standard_normal((dim, max(self.m, 1))), r.uniform(0, self.width, max(self.m, 1))) for r in drawn]
            self.made[dim] = np.concatenate([a for a, _ in made], 1), np.concatenate([b for _, b in made])
        return self.made[dim]

    def _key(self, table: int, dim: int, cells: np.ndarray) -> np.ndarray:
        """Bucket numbers of the last axis of cells."""
        h = np.full(cells.shape[:-1], (table * 1_000_003 + dim) & 0xFFFFFFFF, np.uint64)
        for i in range(cells.shape[-1]):
            h = mix(h ^ (cells[..., i].astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
        return mix(h).view(np.int64)

    def positions(self, unit: np.ndarray) -> np.ndarray:
        a, b = self._of(unit.shape[1])
        return ((unit @ a + b) / self.width).reshape(len(unit), self.tables, -1)[:, :, : self.m]

    def index(self, unit: np.ndarray) -> np.ndarray:
        """(vector, table): keys of own buckets."""
        cells = np.floor(self.positions(unit))
        return np.stack([self._key(t, unit.shape[1], cells[:, t]) for t in range(self.tables)], 1)

    def visit(self, unit: np.ndarray) -> np.ndarray:
        """(vector, table, probe): keys to visit, the likeliest first."""
        at = self.positions(unit)
        cells = np.floor(at)
        out = []
        for t in range(self.tables):
            own = cells[:, t]
            if not self.m:
                out.append(self._key(t, unit.shape[1], own)[:, None])
                continue
            rest = at[:, t] - own
            distance = np.concatenate([rest, 1 - rest], 1)  # down, up
            order = np.argsort(distance, 1, kind="stable")
            cost = np.take_along_axis(distance, order, 1) ** 2 @ self.sets.T
            best = np.argsort(cost, 1, kind="stable")[:, : self.probes]
            step = np.zeros((len(unit), best.shape[1], 2 * self.m))
            np.put_along_axis(step, np.broadcast_to(order[:, None, :], step.shape), self.sets[best].astype(float), 2)
            out.append(self._key(t, unit.shape[1], own[:, None, :] - step[..., : self.m] + step[..., self.m :]))
        return np.stack(out, 1)


def _matrix(raws: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raws), kind).reshape(len(raws), -1).astype(np.float64)


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that no square over- or underflows and nothing is rounded."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])


def _unit(v: np.ndarray) -> np.ndarray:
    v = _scaled(v)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, the same whatever rows lie beside."""
    a, b = _scaled(a), _scaled(b)
    return (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))


def _first_probe(seen: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each of the keys, the place among `seen` at which it is visited, or a large number."""
    order = np.argsort(seen, kind="stable")
    at = np.minimum(np.searchsorted(seen[order], keys), len(seen) - 1)
    return np.where(seen[order[at]] == keys, order[at], 1 << 20)


def fit(asks: np.ndarray, true: list[np.ndarray], sample: np.ndarray, count: int, queries: int, target: float = RECALL) -> tuple[Hashes, float, float]:
    """Hashes for `count` vectors and `queries` queries, their recall on `asks`, and the share of all vectors that a query scores (over all tables).

    asks: some queries; true: the nearest vectors of each; sample: some vectors.
    """
    found: list[tuple] = []
    if not len(asks) or not any(map(len, true)):
        return Hashes(0, 1, 1, 1.0), 1.0, 1.0
    asks, sample, of = _unit(asks), _unit(sample), np.cumsum([0, *map(len, true)])
    near = _unit(np.concatenate([t for t in true if len(t)]))
    for width, m in itertools.product(WIDTHS, HASHES):
        full = Hashes(m, PROBES[-1], TABLES[-1], width)
        seen, own, theirs = full.visit(asks), full.index(sample), full.index(near)
        hit = np.empty((len(near), full.tables), np.int64)
        scored = np.zeros((full.tables, len(PROBES)))
        for q, t in itertools.product(range(len(asks)), range(full.tables)):
            hit[of[q] : of[q + 1], t] = _first_probe(seen[q, t], theirs[of[q] : of[q + 1], t])
            scored[t] += np.searchsorted(np.sort(_first_probe(seen[q, t], own[:, t])), PROBES) / (len(asks) * len(sample))
        for tables in TABLES:
            first = hit[:, :tables].min(1)
            for i, probes in enumerate(PROBES):
                recall, share = (first < probes).mean(), scored[:tables, i].sum()
                if recall >= target:
                    visits = tables * min(probes, seen.shape[2])
                    found.append((tables * count * ROW + queries * (visits * PROBE + min(visits, tables * -(-count // BLOCK)) * ROW + share * count), m, probes, tables, width, recall, share))
                    break
    if not found:
        return Hashes(0, 1, 1, 1.0), 1.0, 1.0
    _, m, probes, tables, width, recall, share = min(found)
    return Hashes(m, probes, tables, width), float(recall), float(share)


def distinct_vectors(table: DataFrame, every: int = EVERY) -> tuple[DataFrame, DataFrame]:
    """Entries (vid, embedding, ids, asks): a row a distinct vector, `vid` its hash of 128 bits; and the queries (query_id, vid)."""
    vid = F.concat(*[F.lpad(F.hex(F.xxhash64(*salt, "embedding")), 16, "0") for salt in ([], [F.lit(1)])])
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine & F.exists("embedding", lambda x: x != 0))
    # -0.0 and 0.0 are one value
    rows = rows.select("vec_id", F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0).cast(table.schema["embedding"].dataType.elementType)).otherwise(x)).alias("embedding"))
    once = rows.withColumn("vid", vid).groupBy("vid", "vec_id", "embedding").agg(F.lit(1).alias("_one")).drop("_one")
    queries = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), vid.alias("vid")).distinct()
    few = once.withColumn("_n", F.row_number().over(Window.partitionBy("vid").orderBy("vec_id"))).filter(F.col("_n") <= K + 1)
    entries = few.groupBy("vid").agg(F.min_by("embedding", "vec_id").alias("embedding"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = queries.select("vid").distinct().withColumn("asks", F.lit(True))
    return entries.join(asked, "vid", "left").withColumn("asks", F.coalesce("asks", F.lit(False))), queries


def _kind(table: DataFrame) -> str:
    return "<f4" if table.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"


CELLS = "cell long, asks boolean, vid string, vec binary, ids binary, keys binary"


def _vectors(batch: pa.RecordBatch, kind: str):
    """(rows, matrix) of a batch's column `embedding`, by dimension, in pieces of about a thousand."""
    vectors = batch.column(batch.schema.get_field_index("embedding"))
    dims = np.asarray(vectors.value_lengths())
    for dim in np.unique(dims):
        for some in np.array_split(np.flatnonzero(dims == dim), max(1, int((dims == dim).sum()) // 1024)):
            yield some, vectors.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(some), dim)


def placed(entries: DataFrame, hashes: Hashes, kind: str, count: int) -> DataFrame:
    """A row for each table of an entry, and for each cell that a query visits, with the keys of its buckets there."""
    slots = max(1, -(-count // BLOCK))  # cells a table

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            vids, asks = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("vid", "asks"))
            ids = batch.column(names.index("ids"))
            for some, own in _vectors(batch, kind):
                unit = _unit(own.astype(np.float64))
                raw = [v.tobytes() for v in own]
                told = [np.array(x, np.int64).tobytes() for x in ids.take(pa.array(some)).to_pylist()]
                keys = hashes.index(unit)
                cells = keys % slots + np.arange(hashes.tables) * slots
                rows = [(int(c), False, vids[some[i]], raw[i], told[i], k.tobytes()) for i in range(len(some)) for c, k in zip(cells[i], keys[i], strict=True)]
                ask = np.flatnonzero(asks[some])
                if len(ask):
                    seen = hashes.visit(unit[ask])
                    at = (seen % slots + np.arange(hashes.tables)[:, None] * slots).reshape(len(ask), -1)
                    for i, k, c in zip(ask, seen.reshape(len(ask), -1), at, strict=True):
                        order = np.argsort(c, kind="stable")
                        first = np.flatnonzero(np.concatenate([[True], c[order][1:] != c[order][:-1]]))
                        rows += [(int(c[o[0]]), True, vids[some[i]], raw[i], None, k[o].tobytes()) for o in np.split(order, first[1:])]
                kinds = [pa.int64(), pa.bool_(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in CELLS.split(", ")])

    return entries.mapInArrow(run, CELLS)


FOUND = "vid string, vec_id long, score double"


def _best(rows: pa.Table, kind: str):
    """(vid, vec_id, score): the best K + 1 candidates of each query of a cell, out of the buckets that it visits there."""
    asks = rows.column("asks").to_numpy(zero_copy_only=False).astype(bool)
    vid = np.array(rows.column("vid").to_pylist(), object)
    raws, ids, keys = (rows.column(c).to_pylist() for c in ("vec", "ids", "keys"))
    sizes = np.array([len(r) for r in raws])
    for size in np.unique(sizes[asks]):
        own, ask = np.flatnonzero(~asks & (sizes == size)), np.flatnonzero(asks & (sizes == size))
        if not len(own):
            continue
        bucket = np.frombuffer(b"".join([keys[i] for i in own]), np.int64)
        order = np.argsort(bucket, kind="stable")
        own, bucket = own[order], bucket[order]
        known = _matrix([raws[i] for i in own], kind)
        unit = _unit(known).astype(np.float32)
        for some in np.array_split(ask, -(-len(ask) // 256)):
            q = _matrix([raws[i] for i in some], kind)
            visits = [np.frombuffer(keys[i], np.int64) for i in some]
            lo, hi = (np.searchsorted(bucket, np.concatenate(visits), side) for side in ("left", "right"))
            ends = np.cumsum([0, *map(len, visits)])
            total = np.add.reduceat(hi - lo, ends[:-1])
            # where most buckets of the cell are visited, one product for all is cheaper than copies of the candidates
            every = _unit(q).astype(np.float32) @ unit.T if total.sum() > 0.05 * len(some) * len(own) else None
            for i, a in enumerate(some):
                x, n = lo[ends[i] : ends[i + 1]], (hi - lo)[ends[i] : ends[i + 1]]
                at = np.repeat(x - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total[i])
                at = at[vid[own[at]] != vid[a]]
                if not len(at):
                    continue
                near = every[i, at] if every is not None else unit[at] @ _unit(q[i : i + 1])[0].astype(np.float32)
                take = min(len(at), K + 1)
                at = at[near >= np.partition(near, len(at) - take)[len(at) - take] - 1e-4]
                exact = cosine(known[at], np.broadcast_to(q[i], (len(at), q.shape[1])))
                out = [(-s, n) for s, o in zip(exact, own[at], strict=True) for n in np.frombuffer(ids[o], np.int64)]
                yield from ((vid[a], n, -s) for s, n in heapq.nsmallest(K + 1, out))


def search(cells: DataFrame, kind: str) -> DataFrame:
    """The best K + 1 candidates of each query in each (cell, probe, block); rows as CELLS, with those numbers."""
    names = ["cell", "probe", "block"]

    def run(batches):
        for rows in whole_groups(batches, names):
            found = list(_best(rows, kind)) if pa.compute.any(rows.column("asks")).as_py() else []
            if found:
                kinds = [pa.string(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], ["vid", "vec_id", "score"])

    return cells.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, FOUND)


def in_blocks(cells: DataFrame) -> DataFrame:
    """Cells with `probe` and `block`: those of many vectors are split into blocks, those of many queries into probes."""
    counted = rekeyed(cells, "cell", F.count_if(~F.col("asks")).alias("n"), F.count_if("asks").alias("q"))
    parts = counted.select("cell", F.greatest(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int").alias("blocks"), F.greatest(F.ceil(F.col("q") / ASKS), F.lit(1)).cast("int").alias("probes"))
    wide = cells.join(materialize(parts.filter("blocks > 1 OR probes > 1"), "wide-cells"), "cell", "left")
    number = lambda n, salt: F.coalesce(F.pmod(F.xxhash64("vid", F.lit(salt)), F.col(n)).cast("int"), F.lit(0))
    split = wide.withColumn("_other", F.explode(F.sequence(F.lit(0), F.coalesce(F.when(F.col("asks"), F.col("blocks")).otherwise(F.col("probes")), F.lit(1)) - 1)))
    return split.select(*cells.columns, F.when(F.col("asks"), number("probes", 1)).otherwise(F.col("_other")).alias("probe"), F.when(F.col("asks"), F.col("_other")).otherwise(number("blocks", 2)).alias("block"))


def true_neighbours(entries: DataFrame, asks: list[tuple[str, np.ndarray]], kind: str) -> list[np.ndarray]:
    """The K nearest vectors of each of some queries among all entries, by one exact pass; equal vectors are left out."""

    def run(batches):
        best: list[list] = [[] for _ in asks]
        for batch in batches:
            vids = batch.column(batch.schema.get_field_index("vid")).to_pylist()
            for some, own in _vectors(batch, kind):
                same = [i for i, (_, v) in enumerate(asks) if len(v) == own.shape[1]]
                if not same:
                    continue
                near = _unit(np.array([asks[i][1] for i in same], np.float64)) @ _unit(own.astype(np.float64)).T
                for i, row in zip(same, near, strict=True):
                    for j in np.argpartition(-row, min(K, len(row) - 1))[: K + 1]:
                        if vids[some[j]] != asks[i][0]:
                            best[i].append((row[j], vids[some[j]], own[j].tobytes()))
                    best[i] = heapq.nlargest(K, best[i])
        rows = [(i, *x) for i, some in enumerate(best) for x in some]
        if rows:
            kinds = [pa.int32(), pa.float64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["ask", "score", "vid", "vec"])

    found = entries.select("vid", "embedding").mapInArrow(run, "ask int, score double, vid string, vec binary")
    first = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "vid"))
    out: list[list[bytes]] = [[] for _ in asks]
    for r in found.withColumn("_n", first).filter(F.col("_n") <= K).collect():  # K a query
        out[r["ask"]].append(r["vec"])
    return [_matrix(v, kind) if v else np.zeros((0, len(a))) for v, (_, a) in zip(out, asks, strict=True)]


def fitted(entries: DataFrame, kind: str, count: int) -> tuple[Hashes, float, float]:
    """fit() on a bounded sample of the entries, by the hashes of their vectors."""
    at = F.xxhash64("vid")
    some = lambda rows, n: [(r["vid"], np.array(r["embedding"], np.float64)) for r in rows.orderBy(at, "vid").limit(n).select("vid", "embedding").collect()]
    sample, asks = some(entries, FIT_SAMPLE), some(entries.filter("asks"), FIT_QUERIES)
    dims = [len(v) for _, v in sample]
    usual = max(set(dims), key=dims.count) if dims else 0
    asks = [(i, v) for i, v in asks if len(v) == usual]
    if not asks:
        return Hashes(0, 1, 1, 1.0), 1.0, 1.0
    true = true_neighbours(entries, asks, kind)
    return fit(np.array([v for _, v in asks]), true, np.array([v for _, v in sample if len(v) == usual]), count, entries.filter("asks").count())


def own_copies(entries: DataFrame, kind: str) -> DataFrame:
    """For each query vector, the ids of equal vectors, as FOUND."""

    def run(batches):
        for batch in batches:
            vids, vectors, ids = (batch.column(k).to_pylist() for k in range(3))
            rows = []
            for vid, v, some in zip(vids, vectors, ids, strict=True):
                x = np.array([v], kind).astype(np.float64)
                rows += [(vid, n, float(cosine(x, x)[0])) for n in some]
            kinds = [pa.string(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 3, kinds, strict=True)], ["vid", "vec_id", "score"])

    return entries.filter("asks").select("vid", "embedding", "ids").mapInArrow(run, FOUND)


def nearest(table: DataFrame, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id `every` divides, its K nearest of the others."""
    kind = _kind(table)
    entries, queries = distinct_vectors(table, every)
    entries = materialize(entries, "vectors")
    queries = materialize(queries, "vector-queries")
    count = entries.count()
    hashes, _, _ = fitted(entries, kind, count)
    copies = own_copies(entries, kind)
    found, asking, wanted = copies, entries, min(K + 1, count)
    while True:
        cells = materialize(placed(asking, hashes, kind, count), "vector-cells")
        found = materialize(found.unionByName(search(in_blocks(cells), kind)).distinct(), "found")
        if not hashes.m:
            break
        enough = found.groupBy("vid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= wanted).select("vid")
        lacking = materialize(entries.filter("asks").select("vid").join(enough, "vid", "left_anti"), "lacking")
        if not lacking.limit(1).count():
            break
        asking = entries.drop("asks").join(lacking.withColumn("asks", F.lit(True)), "vid", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
        hashes = Hashes(hashes.m // 2, PROBES[-1], hashes.tables, hashes.width) if hashes.probes < PROBES[-1] else Hashes(0, 1, 1, 1.0)
    top = found.withColumn("_n", F.row_number().over(Window.partitionBy("vid").orderBy(F.desc("score"), "vec_id"))).filter(F.col("_n") <= K + 1).drop("_n")
    mine = queries.join(top, "vid").filter("vec_id != query_id")
    ranked = mine.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= K).select("query_id", "rank", "vec_id", "score")


def op1_multiprobe_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

"""Near-duplicate classes by DartMinHash signatures.

A text is a weighted set: its shingles of five words, weighted by how often they occur.  Every element has a random
process of darts over weight and rank that depends on the element alone; a text is hit by the darts under its elements'
weights.  Darts are thrown region by region (weights and ranks in powers of two), only as far in rank as about k ln k + 2k
darts reach, so the work follows the number of elements plus the number of darts.  Each dart has one of k coordinates; the
earliest dart of a coordinate is the signature there, and two texts agree with probability equal to their weighted Jaccard
similarity.  Bands of the signature give buckets.

Links, without ever forming the pairs of a bucket:
1. every text of a bucket is compared with three leaders of it (least by three orders), exactly, on its shingles;
2. components of the links found join most of each bucket; where they do not, what lies outside the largest component is
   compared with three more leaders, ROUNDS times;
3. in buckets that still hold several components, all texts outside the largest one are compared with the whole bucket, in
   blocks of bounded size, each pair in the first band it shares, unless lengths or counts of shingles by bins show that they
   can't be alike; a block returns no more links than join its components.
Every pair of different texts that share a band is thus either compared on its whole shingle sets, or shown to be less alike by
a bound that holds always, or already in one class: no link of such a pair is lost.

Copies of a text are one node, known by 128 bits.  Defined results: a text of fewer than five words is one shingle of all its words; a text
without words is only like its exact copies; a null text is alone; the class of a document is the least doc_id in it;
repeated rows are copies; very long texts
are taken whole; of equal texts the least doc_id stays; an empty table gives an empty result; other columns are kept by `without_near_copies`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.llm.common import Words, aside, materialize, mix, rekeyed, slices, text_ids, trimmed, whole_groups
from corpuscle.llm.graph import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5  # a pair at 0.8 shares no band once in 20,000 times
ROUNDS = 1  # of more leaders
BLOCK = 2048
BINS = 512
ROUNDING = 1e-6  # so that exactly 0.8 counts
SLICE_BYTES = 1 << 18  # worked on at a time
BASE_RANK = 2.0**-6
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_CDF: dict[float, np.ndarray] = {}


def _poisson_cdf(rate: float) -> np.ndarray:
    if rate not in _CDF:
        n = np.arange(int(rate + 12 * np.sqrt(rate) + 25))
        logs = n * np.log(rate) - rate - np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, len(n))))])
        _CDF[rate] = np.cumsum(np.exp(logs))
    return _CDF[rate]


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _darts(element: np.ndarray, weight: np.ndarray, reach: np.ndarray):
    """(element's number, rank, dart's id) of the darts that hit: under the weight, and of a rank below reach."""
    heaviest, furthest = weight.max(), reach.max()
    low_w, step_w, i = 0.0, 1.0, 0
    while low_w < heaviest:
        low_r, step_r, j = 0.0, BASE_RANK, 0
        while low_r < furthest:
            some = np.flatnonzero((weight > low_w) & (reach > low_r)) if (i or j) else np.arange(len(element))
            seed = mix(element[some] + np.uint64((0x9E3779B97F4A7C15 * (1 + i * 4096 + j)) & 0xFFFFFFFFFFFFFFFF))
            rate, u = step_w * step_r, _unit(seed)
            hit = np.flatnonzero(u > np.exp(-rate))
            if len(hit):
                cdf = _poisson_cdf(rate)
                count = np.searchsorted(cdf, u[hit], "left")
                of = np.repeat(hit, count)
                nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                dart = mix(seed[of] ^ (_C[1] * (nth.astype(np.uint64) + np.uint64(1))))
                at = some[of]
                rank = low_r + step_r * _unit(mix(dart ^ _C[2]))
                ok = rank < reach[at]
                if low_w + step_w > 1 or heaviest < 1 or weight.min() < 1:
                    ok &= low_w + step_w * _unit(mix(dart ^ _C[3])) < weight[at]
                yield at[ok], rank[ok], dart[ok]
            low_r, step_r, j = low_r + step_r, (step_r if j == 0 else 2 * step_r), j + 1
        low_w, step_w, i = low_w + step_w, (step_w if i == 0 else 2 * step_w), i + 1


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, k: int = BANDS * ROWS) -> np.ndarray:
    """The k ids of each document's earliest darts; documents without elements get zeros."""
    out = np.zeros(docs * k, np.uint64)
    total = np.bincount(doc, weight, minlength=docs)
    reach = np.where(total > 0, k * (np.log(k) + 2) / np.maximum(total, 1e-300), 0)
    left = total > 0
    while left.any():
        some = np.flatnonzero(left[doc])
        best = np.full(docs * k, np.inf)
        thrown = list(_darts(element[some], weight[some], reach[doc[some]]))
        at, rank, dart = (np.concatenate([t[i] for t in thrown]) for i in range(3))
        key = doc[some][at] * k + (dart % np.uint64(k)).astype(np.int64)
        np.minimum.at(best, key, rank)
        won = rank == best[key]
        out[key[won]] = dart[won]
        full = np.isfinite(best).reshape(docs, k).all(1)
        left &= ~full
        reach = reach * 2
    return out.reshape(docs, k)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight) of a slice's distinct shingles, and the number of words of each document."""
    words = Words(texts)
    at, h = words.windows(SHINGLE)
    doc = words.doc[at]
    for n in range(1, SHINGLE):
        few = words.count == n
        if few.any():
            first, short = words.windows(n)
            own = few[words.doc[first]]
            doc, h = np.concatenate([doc, words.doc[first][own]]), np.concatenate([h, short[own]])
    key = mix(h ^ (doc.astype(np.uint64) * _C[1]))
    _, first, weight = np.unique(key, return_index=True, return_counts=True)
    return doc[first], h[first], weight.astype(float), words.count


def _distinct_texts(batch: pa.RecordBatch):
    ids, texts = batch.column(0), batch.column(1)
    keep = np.flatnonzero(~np.asarray(ids.is_null()))
    values = ids.take(pa.array(keep)).to_numpy(zero_copy_only=False).astype(np.int64)
    own, first = np.unique(values, return_index=True)
    order = np.argsort(first)
    own, some = own[order], texts.take(pa.array(keep[first[order]]))
    for i, j in slices(some, SLICE_BYTES):
        yield own[i:j], some.slice(i, j - i)


def sketches(texts: DataFrame) -> DataFrame:
    """(tid, weight, sig) of every distinct text (tid, text) that has words."""

    def run(batches):
        for batch in batches:
            for tid, some in _distinct_texts(batch):
                doc, element, weight, _ = shingles(some)
                sig = signatures(doc, element, weight, len(tid))
                total = np.bincount(doc, weight, minlength=len(tid)).astype(np.int64)
                has = np.flatnonzero(total)
                raw = (sig & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array(tid[has], pa.int64()), pa.array(total[has], pa.int64()), pa.array([raw[k].tobytes() for k in has], pa.binary())], ["tid", "weight", "sig"])

    found = texts.select("tid", "text").mapInArrow(trimmed(run), "tid long, weight long, sig binary")
    return found.groupBy("tid").agg(F.max("weight").alias("weight"), F.max("sig").alias("sig"))


PAGE = 19  # bits of the filter that a row holds, as a power of two


def node_filter(nodes: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of the text ids in nodes, of 2**27 bits at most.

    Beyond some ten million ids it lets more through, and in the end all: then the sets of all texts are shuffled, which
    are smaller than the texts.
    """
    bits = 1 << min(27, max(PAGE, (16 * nodes.count()).bit_length()))
    place = F.explode(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.pmod(F.xxhash64("tid", k), F.lit(bits))))
    words = nodes.select(place.alias("p")).groupBy(F.floor(F.col("p") / 32).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p % 32 AS INT))")).alias("v"))
    paged = words.withColumn("page", F.shiftright("w", PAGE - 5).cast("int"))

    def filled(table: pa.Table) -> pa.Table:
        own = np.zeros(1 << (PAGE - 5), np.uint32)
        own[table.column("w").to_numpy() & ((1 << (PAGE - 5)) - 1)] = table.column("v").to_numpy().astype(np.uint32)
        return pa.table({"page": pa.array([table.column("page")[0].as_py()], pa.int32()), "bits": pa.array([own.tobytes()], pa.binary())})

    out = np.zeros(bits >> 5, np.uint32)
    for r in paged.groupBy("page").applyInArrow(filled, "page int, bits binary").collect():  # 256 rows at most
        out[r["page"] << (PAGE - 5) : (r["page"] + 1) << (PAGE - 5)] = np.frombuffer(r["bits"], np.uint32)
    return out, bits


def shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tid, elements) of the texts in nodes, and perhaps some more: sorted 32-bit hashes of a text's shingles, each as often as it occurs.

    Texts are chosen where they lie; only the sets of those chosen are shuffled.
    """
    found, bits = node_filter(nodes)
    shared = docs.sparkSession.sparkContext.broadcast(found)  # 16 MB at most

    def run(batches):
        for batch in batches:
            places = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6)]) if batch.num_rows else np.zeros((4, 0), np.int64)
            inside = ((shared.value[places >> 5] >> (places & 31).astype(np.uint32)) & np.uint32(1)).all(0)
            some = batch.filter(pa.array(inside))
            for tid, texts in _distinct_texts(some):
                doc, h, weight, _ = shingles(texts)
                again = np.repeat(np.arange(len(h)), weight.astype(np.int64))
                nth = np.arange(len(again)) - np.repeat(np.cumsum(weight) - weight, weight.astype(np.int64)).astype(np.int64)
                doc, e = doc[again], (mix(h[again] + _C[2] * nth.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)
                order = np.lexsort((e, doc))
                doc, e = doc[order], e[order]
                cut = np.searchsorted(doc, np.arange(len(tid) + 1))
                yield pa.RecordBatch.from_arrays([pa.array(tid, pa.int64()), pa.array([e[cut[k] : cut[k + 1]].tobytes() for k in range(len(tid))], pa.binary())], ["tid", "elements"])

    placed = docs.select("tid", "text", *[F.pmod(F.xxhash64("tid", F.lit(k)), F.lit(bits)).alias(f"p{k}") for k in (1, 2, 3, 4)])
    chosen = placed.mapInArrow(trimmed(run), "tid long, elements binary")
    return chosen.groupBy("tid").agg(F.max("elements").alias("elements"))


def _similar(batches):
    """Of pairs with both sets: the ones at least SIMILARITY alike."""
    for batch in batches:
        least = batch.column(4).to_numpy(zero_copy_only=False)
        keep = np.zeros(batch.num_rows, bool)
        for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            a, b = np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)
            if min(len(a), len(b)) < least[k] * max(len(a), len(b)) - ROUNDING:
                continue
            keep[k] = _alike(a, b, least[k])
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["u", "v"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of text ids that are alike enough, by their whole shingle sets."""
    joined = pairs.join(sets.select(F.col("tid").alias("u"), F.col("elements").alias("a")), "u").join(sets.select(F.col("tid").alias("v"), F.col("elements").alias("b")), "v")
    return joined.select("u", "v", "a", "b", F.lit(similarity).alias("least")).mapInArrow(trimmed(_similar), "u long, v long")


def buckets(known: DataFrame) -> DataFrame:
    """(key, tid, band): a row a band."""
    bands = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    return known.select("tid", "sig", bands.alias("band")).select(F.xxhash64("band", F.substring("sig", F.col("band") * (4 * ROWS) + 1, F.lit(4 * ROWS))).alias("key"), "tid", "band")


def led_buckets(members: DataFrame, *more) -> DataFrame:
    """(key, n, leaders, ...): of each bucket the number of texts and up to three of them that all others are compared with."""
    leaders = [F.min("tid"), *(F.min_by("tid", F.xxhash64(F.col("tid"), F.lit(k))) for k in (1, 2))]
    led = rekeyed(members, "key", F.count(F.lit(1)).alias("n"), *[x.alias(f"l{k}") for k, x in enumerate(leaders)], *more)
    return led.withColumn("leaders", F.array_distinct(F.array("l0", "l1", "l2"))).drop("l0", "l1", "l2")


def leader_pairs(members: DataFrame) -> DataFrame:
    """Every text with each leader of its buckets."""
    led = led_buckets(members).filter("n > 1")
    pairs = members.join(led, "key").select("tid", F.explode("leaders").alias("leader")).filter("tid != leader")
    return pairs.select(F.greatest("tid", "leader").alias("u"), F.least("tid", "leader").alias("v")).distinct()


def mixed_buckets(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Buckets of several components: (key, tid, band, root, main, n, most), main the largest component and `most` its texts there.

    Where all texts but one are leaders every pair has been compared, so such buckets are left out.
    """
    own = members.join(roots.select(F.col("u").alias("tid"), F.col("v").alias("root")), "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    several = led_buckets(own, F.min("root").alias("a"), F.max("root").alias("b")).filter((F.col("a") < F.col("b")) & (F.col("n") - F.size("leaders") >= 2)).select("key")
    inside = materialize(own.join(several, "key"), "mixed-buckets")
    sizes = inside.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    shape = rekeyed(sizes, "key", F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"))
    return inside.join(shape, "key")


def more_leader_pairs(inside: DataFrame, number: int) -> DataFrame:
    """Texts outside the largest component of a bucket, each with three more leaders of it that are in other components."""
    leaders = [F.min_by(F.struct("tid", "root"), F.xxhash64("tid", F.lit(3 * number + k))).alias(f"l{k}") for k in range(3)]
    led = rekeyed(inside, "key", *leaders)
    pairs = inside.filter(F.col("root") != F.col("main")).select("key", "tid", "root").join(led, "key").select("tid", "root", F.explode(F.array("l0", "l1", "l2")).alias("l")).filter("root != l.root")
    return pairs.select(F.greatest("tid", "l.tid").alias("u"), F.least("tid", "l.tid").alias("v")).distinct()


def cells(inside: DataFrame, known: DataFrame, sets: DataFrame) -> DataFrame:
    """Mixed buckets in blocks: all texts, and beside them those outside the largest component."""
    placed = inside.join(known, "tid").join(sets, "tid")
    blocks, probes = F.ceil(F.col("n") / BLOCK).cast("int"), F.greatest(F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int"), F.lit(1))
    at = lambda n, salt: F.pmod(F.xxhash64("tid", F.lit(salt)), n).cast("int")
    rest = ["band", "tid", "root", "weight", "sig", "elements"]
    as_member = placed.select("key", F.explode(F.sequence(F.lit(0), probes - 1)).alias("probe"), at(blocks, 1).alias("block"), F.lit(False).alias("asks"), *rest)
    asks = placed.filter(F.col("root") != F.col("main"))
    as_probe = asks.select("key", at(probes, 2).alias("probe"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(True).alias("asks"), *rest)
    return as_member.unionByName(as_probe)


CELL = ["key", "probe", "block"]


def _alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Of two sorted sets."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common >= similarity * (len(both) - common) - ROUNDING


def _cell_links(rows: pa.Table, similarity: float):
    """Links between components in one cell, enough of them to join what belongs together.

    A pair is looked at only in the first band it shares, so once in all cells, and only while its texts are not joined.
    Two sets have no more in common than the smaller of their counts in each of BINS classes of elements; pairs that would
    need more are not alike.
    """
    asks = rows.column("asks").to_numpy(zero_copy_only=False).astype(bool)
    tid, root, weight, band = (rows.column(c).to_numpy() for c in ("tid", "root", "weight", "band"))
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint32).reshape(len(tid), BANDS, ROWS)
    sets = [np.frombuffer(x, np.uint32) for x in rows.column("elements").to_pylist()]
    counts = np.stack([np.bincount(x & np.uint32(BINS - 1), minlength=BINS) for x in sets]).astype(np.int32)
    _, group = np.unique(root, return_inverse=True)
    label = np.arange(group.max() + 1)  # of each component of the cell; equal once joined
    members = np.flatnonzero(~asks)
    for p in np.flatnonzero(asks):
        small, large = np.minimum(weight[members], weight[p]), np.maximum(weight[members], weight[p])
        some = members[(label[group[members]] != label[group[p]]) & (small >= similarity * large - ROUNDING)]
        if not len(some):
            continue
        some = some[(sig[some] == sig[p]).all(2).argmax(1) == band[p]]
        most = np.minimum(counts[some], counts[p]).sum(1)
        some = some[most >= similarity * (weight[some] + weight[p] - most) - ROUNDING]
        for m in some:
            if label[group[m]] != label[group[p]] and _alike(sets[p], sets[m], similarity):
                label[label == label[group[m]]] = label[group[p]]
                yield max(tid[p], tid[m]), min(tid[p], tid[m])


def cross_links(dealt: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links found in the cells."""

    def run(batches):
        for rows in whole_groups(batches, CELL):
            pairs = np.array(list(_cell_links(rows, similarity)), np.int64).reshape(-1, 2)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    return dealt.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(trimmed(run), "u long, v long").distinct()


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(tid, class_id): the class of every text, for documents (doc_id, text, tid), tid by text_ids."""
    own = docs.select("doc_id", "tid", "text").filter(F.col("tid").isNotNull())
    known = materialize(sketches(own), "sketches")
    members = buckets(known)
    pairs = materialize(leader_pairs(members), "pairs")
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("tid")).distinct()
    sets = materialize(shingle_sets(own, nodes), "shingles")  # of all texts that share a bucket
    first = materialize(verified(pairs, sets, similarity), "links")
    roots = components(first)
    for number in range(1, ROUNDS + 1):
        links = materialize(verified(more_leader_pairs(mixed_buckets(members, roots), number), sets, similarity), "links")
        if not links.limit(1).count():
            break
        roots = components(roots.unionByName(links))
    second = materialize(cross_links(cells(mixed_buckets(members, roots), known, sets), similarity), "links")
    roots = components(roots.unionByName(second)) if second.limit(1).count() else roots
    least = rekeyed(own, "tid", F.min("doc_id").alias("least")).join(roots.select(F.col("u").alias("tid"), F.col("v").alias("root")), "tid", "left")
    least = least.withColumn("root", F.coalesce("root", "tid"))
    return materialize(least.join(rekeyed(least, "root", F.min("least").alias("class_id")), "root").select("tid", "class_id"), "classes")


def without_near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class: a row of its least doc_id; null texts stay."""
    inner, back = aside(docs)
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_id")
    tid = text_ids(docs)
    found = classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", tid.alias("tid")), similarity)
    # one (text, id) of each class is chosen before any text is shuffled; joined on both, copies are spread
    chosen = docs.select(tid.alias("tid"), number).join(found.withColumn("class_id", F.coalesce("class_id", F.lit(-(1 << 63)))), "tid").filter("_id = class_id")
    first = F.row_number().over(Window.partitionBy("class_id").orderBy("tid"))
    keep = chosen.withColumn("_n", first).filter("_n = 1").select(F.col("tid").alias("_tid"), "_id")
    rows = inner.select("*", tid.alias("_tid"), number).join(keep, ["_tid", "_id"])
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_tid", "_id").orderBy("_tid"))).filter("_n = 1")
    return back(once).unionByName(docs.filter(F.col("text").isNull()))


def op7_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.withColumn("tid", text_ids(docs))
    out = docs.select("doc_id", "tid").join(classes(docs), "tid", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    return out.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


# all pairs that share a shingle, and the closure of their links
ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS words FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, array_to_string(list_slice(words, i, i + {SHINGLE - 1}), ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {SHINGLE - 1}, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
c AS MATERIALIZED (SELECT doc_id, hash(shingle) AS shingle, count(*) AS n FROM s GROUP BY ALL),
z AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS common FROM c x JOIN c y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE common >= {SIMILARITY} * (x.n + y.n - common) - {ROUNDING}
  UNION SELECT x.doc_id, y.doc_id FROM documents x JOIN documents y ON x.text = y.text AND x.doc_id < y.doc_id),
l AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id WHERE r.root < l.b)
SELECT doc_id, min(root) AS class_id, doc_id = min(root) AS kept FROM r GROUP BY doc_id
"""

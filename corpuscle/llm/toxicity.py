"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

A feature is an n-gram of 4 to 6 characters within a blank-delimited word of the lower-cased text, blanks at its ends
included, hashed to one of 2**20 buckets and counted once a document.  On a bounded sample of labelled rows (MAX_TRAIN_ROWS
rows of documents that are there, MAX_TRAIN_BYTES of text, in the order of a hash of their ids):
1. document frequencies of each bucket in toxic and other rows are summed over the executors;
2. buckets in LEAST_SEEN rows or more whose log-likelihood ratio is LEAST_GAIN or more are the features, of more than
   MAX_FEATURES those with the greatest ratio, with r = log of the smoothed frequencies' ratio; all are parameters of the model;
3. a logistic regression with an L2 penalty is fitted to the rows' r-scaled features.
The model, of at most 2**20 floats, is sent to all tasks, which score whole texts.

Defined results: null and empty texts score by the bias alone; labels that are null, or of no document, are not learnt;
several labels of one document count as their largest; extra columns of any name are carried along; without labels of both kinds every score is the share of toxic
labels (0 without any); repeated rows get equal scores and are learnt once; very long texts are scored whole, and of those
chosen for learning the last may pass MAX_TRAIN_BYTES; equal ratios go to the smaller bucket; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.llm.common import aside, lean_batches, materialize, mix, slices, trim, trimmed

GRAMS = (4, 5, 6)
BITS = 20
MAX_TRAIN_ROWS = 20_000  # of labelled rows, the ones with the least hashes of their ids
MAX_TRAIN_BYTES = 256 << 20  # of their texts
MAX_FEATURES = 32_768  # of the model; train() takes any number, or none
LEAST_SEEN = 3  # rows with a bucket
LEAST_GAIN = 10.83  # of a bucket's log-likelihood ratio; chi-squared at 0.001
THRESHOLD = 0.7
BLOCK = 4096
SLICE = 1 << 17  # characters or bytes worked on at a time; what fits a cache is twice as fast
_STEP = np.uint64(0x9E3779B97F4A7C15)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every n-gram in a word; repeated ones are still there."""
    joined = ["\0 " + (t or "").lower() + " " for t in texts]
    codes = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13)) | (codes == 0) | (codes == 0xA0) | (codes == 0x3000)
    doc = np.cumsum(codes == 0) - 1
    c = np.where(blank, np.uint64(32), codes.astype(np.uint64)) + np.uint64(1)
    inner = np.concatenate([[0], np.cumsum(blank)])
    docs, buckets = [], []
    h = c * _STEP
    for n in range(2, max(GRAMS) + 1):
        if len(c) < n:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * _STEP + c[n - 1 :]
        if n in GRAMS:
            m = len(c) - n + 1
            at = np.flatnonzero(inner[n - 1 : n - 1 + m] == inner[1 : 1 + m])  # no blank but at the ends
            at = at[codes[at] != 0]
            docs.append(doc[at])
            buckets.append((mix(h[at] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(docs), np.concatenate(buckets)


def held_out(doc_id: Column | None = None) -> Column:
    """Rows whose labels are never learnt."""
    return F.coalesce(F.pmod(F.crc32((F.col("doc_id") if doc_id is None else doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN_ROWS, most_bytes: int = MAX_TRAIN_BYTES) -> DataFrame:
    """(toxic, text) of the bounded sample.  Rows are chosen by ids, hashes and lengths; only chosen texts are moved."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")  # else labels of absent documents would use the bound up
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    place = [F.xxhash64("doc_id"), "doc_id", "_hash"]
    narrow = docs.select("doc_id", F.xxhash64("text").alias("_hash"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("_size"))
    rows = narrow.join(F.broadcast(chosen), "doc_id").distinct().orderBy(*place).limit(most)
    before = F.coalesce(F.sum("_size").over(Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # of `most` rows
    rows = rows.withColumn("_before", before).filter(F.col("_before") < most_bytes).select("doc_id", "_hash", "toxic")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash")).join(F.broadcast(rows), ["doc_id", "_hash"])
    return texts.dropDuplicates(["doc_id", "_hash"]).select(F.col("toxic").cast("int").alias("toxic"), "text")


def _frequencies(batches):
    """For each block of buckets: the buckets seen and their document frequencies, not toxic and toxic."""
    total = np.zeros((2, 1 << BITS), np.int32)
    rows = np.zeros(2, np.int64)
    for batch in batches:
        y, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        rows += np.bincount(y > 0, minlength=2)
        for i, j in slices(texts, SLICE):
            doc, bucket = features(texts.slice(i, j - i).to_pylist())
            one = np.unique((doc << BITS) | bucket)
            for k in (0, 1):
                total[k] += np.bincount((one & ((1 << BITS) - 1))[(y[i:j] > 0)[one >> BITS] == k], minlength=1 << BITS).astype(np.int32)
    out = [(-1, b"", rows.astype(np.int32).tobytes())]
    for b in range(0, 1 << BITS, BLOCK):
        part = total[:, b : b + BLOCK]
        at = np.flatnonzero(part.any(0))
        if len(at):
            out.append((b, at.astype(np.uint16).tobytes(), part[:, at].tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "at", "counts"])


def _sums(table: pa.Table) -> pa.Table:
    block = table.column("block")[0].as_py()
    total = np.zeros((2, 2 if block < 0 else BLOCK), np.int64)
    for at, counts in zip(table.column("at").to_pylist(), table.column("counts").to_pylist(), strict=True):
        if block < 0:
            total[:, 0] += np.frombuffer(counts, np.int32)
        else:
            total[:, np.frombuffer(at, np.uint16)] += np.frombuffer(counts, np.int32).reshape(2, -1)
    at = np.flatnonzero(total.sum(0) >= LEAST_SEEN) if block >= 0 else np.array([0])
    return pa.table({"bucket": pa.array(at + block, pa.int64()), "clean": pa.array(total[0, at], pa.int64()), "toxic": pa.array(total[1, at], pa.int64())})


def _gain(a: Column, n: Column, b: Column, m: Column) -> Column:
    """Log-likelihood ratio of a of n against b of m."""

    def term(x: Column, e: Column) -> Column:
        return F.when(x > 0, x * F.log(x / e)).otherwise(0.0)

    seen, rows = a + b, n + m
    return 2 * (term(a, seen * n / rows) + term(b, seen * m / rows) + term(n - a, (rows - seen) * n / rows) + term(m - b, (rows - seen) * m / rows))


class Model:
    """weights: of each bucket; bias."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def score(self, texts: list[str | None]) -> np.ndarray:
        doc, bucket = features(texts)
        told = np.flatnonzero(self.weights[bucket])
        one = np.unique((doc[told] << BITS) | bucket[told])
        z = self.bias + np.bincount(one >> BITS, self.weights[one & ((1 << BITS) - 1)].astype(float), minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _fit(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, rounds: int = 200, penalty: float = 0.05) -> tuple[np.ndarray, float]:
    """Logistic regression on binary features scaled by r: full-batch Adam, which needs no line search."""
    blocks = []
    for i in range(0, len(rows), 512):  # what stands beside the rows stays small
        some = rows[i : i + 512]
        lengths = np.array([len(x) for x in some])
        full = np.flatnonzero(lengths)
        if len(full):
            blocks.append((i + full, lengths[full], (np.cumsum(lengths) - lengths)[full], np.concatenate(some).astype(np.int32)))
    w, bias = np.zeros(len(r)), float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for k in range(1, rounds + 1):
        z, u, gw = np.full(len(rows), bias), w * r, penalty * w / len(y)
        for full, _, starts, at in blocks:
            z[full] += np.add.reduceat(u[at], starts)
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        for full, lengths, _, at in blocks:
            gw = gw + r * np.bincount(at, np.repeat(g[full], lengths), minlength=len(w))
        gb = g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        rate = 0.05 / (1 + k / 100)
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**k)) / (np.sqrt(vb / (1 - 0.999**k)) + 1e-8)
    return w, bias


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN_ROWS, most_features: int | None = MAX_FEATURES) -> Model:
    """most_features: None for all that LEAST_GAIN lets through, which the 2**BITS buckets bound."""
    spark = docs.sparkSession
    sample = materialize(training_rows(docs, labels, most).repartition(8), "toxicity-sample")
    counts = sample.mapInArrow(trimmed(_frequencies), "block int, at binary, counts binary").groupBy("block").applyInArrow(_sums, "bucket long, clean long, toxic long")
    counts = materialize(counts, "toxicity-counts")
    rows = counts.filter(F.col("bucket") < 0).agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).first()
    n, m = rows["clean"] or 0, rows["toxic"] or 0
    if not n or not m:
        share = m / (n + m) if n + m else 0.0
        return Model(np.zeros(1 << BITS), np.log((share + 1e-9) / (1 - share + 1e-9)))
    told = counts.filter(F.col("bucket") >= 0).withColumn("gain", _gain(F.col("clean"), F.lit(float(n)), F.col("toxic"), F.lit(float(m)))).filter(F.col("gain") >= LEAST_GAIN)
    top = told.orderBy(F.desc("gain"), "bucket").limit(most_features or 1 << BITS).collect()
    if not top:
        return Model(np.zeros(1 << BITS), np.log(m / n))
    bucket, a, b = (np.array([t[k] for t in top]) for k in ("bucket", "clean", "toxic"))
    r = np.log((b + 1) / (m + 2)) - np.log((a + 1) / (n + 2))
    kind = np.dtype(np.uint16 if len(bucket) <= 1 << 16 else np.uint32)
    index = np.full(1 << BITS, -1, np.int32)
    index[bucket] = np.arange(len(bucket))
    shared = spark.sparkContext.broadcast(index)  # 4 MB whatever the corpus holds

    def rows_of(batches):
        for batch in batches:
            texts, out = batch.column(1), []
            for i, j in slices(texts, SLICE):
                doc, found = features(texts.slice(i, j - i).to_pylist())
                at = shared.value[found]
                one = np.unique((doc[at >= 0] << BITS) | at[at >= 0])
                cut = np.searchsorted(one >> BITS, np.arange(j - i + 1))
                one = (one & ((1 << BITS) - 1)).astype(kind)
                out += [one[cut[k] : cut[k + 1]].tobytes() for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["toxic", "found"])

    fitted = sample.mapInArrow(trimmed(rows_of), "toxic int, found binary").collect()  # at most `most` rows of a few hundred numbers
    found, y = [np.frombuffer(f["found"], kind) for f in fitted], np.array([float(f["toxic"] > 0) for f in fitted])
    del fitted
    w, bias = _fit(found, y, r)
    weights = np.zeros(1 << BITS)
    weights[bucket] = w * r
    return Model(weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with `score`, of whole texts; a narrow transformation that sends texts to Python and only scores back."""
    lean_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        own = Model(*shared.value)
        texts = text.tolist()
        ends = np.cumsum([len(t or "") + 1 for t in texts])
        cut = [0, *np.searchsorted(ends, np.arange(SLICE, ends[-1], SLICE)).tolist(), len(texts)] if texts else [0]
        trim()
        parts = [own.score(texts[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True) if j > i]
        return pd.Series(np.concatenate([*parts, np.zeros(0)]))

    return docs.withColumn("score", scored("text"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score less than the threshold."""
    model = train(docs.select("doc_id", "text"), labels)
    inner, back = aside(docs)
    return back(score(inner, model).filter(F.col("score") < threshold))


def op6_nbsvm_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Importance resampling of documents towards a target distribution of hashed word n-grams.

Features of a text are its runs of 1 to 3 words; each falls into one of BUCKETS buckets.  Two passes read the texts:
1. every partition counts its buckets by np.bincount into one vector of BUCKETS longs, and treeReduce merges the vectors,
   of the documents and of the target texts alike, so that the driver meets a few vectors whatever there is to read;
2. the gains of the buckets, an array of BUCKETS longs and so bounded, are broadcast, gathered for every feature, and summed
   for each document by np.bincount with weights.
Texts are never shuffled.  Documents are drawn by Gumbel scores: rows of four numbers are put in the order of their scores by
ranges, and a row's rank is its place in its range after the rows of the ranges before, which only counts tell.

Defined results: a null text has no words, so no features and weight 0; null doc_ids are returned without a score and are
neither counted nor drawn; repeated rows count and are scored as often as they are there, and of equal scores and doc_ids the one
of fewer features, then of the lesser weight, is drawn first; very long texts are read whole; without target texts, or
without documents, T or S is 0 and the formulas hold as they stand; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm.common import CRC_TABLE_SQL, crc_sql, materialize, slices, text_buffer, trimmed

BUCKETS = 10_000
LONGEST = 3  # words of a feature
LEAST_WORDS = 20  # of a document that may be drawn
PERCENT = 5
SEED = 42
SHORT = 32  # bytes of words whose CRC-32 is taken in step

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_CRC = _crc_table()


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given as what each value of each byte becomes."""
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


def _zeros() -> list[np.ndarray]:
    """For each k, what a CRC becomes when 2**k zero bytes follow."""
    places = np.arange(256, dtype=np.uint32)
    one = np.stack([places << np.uint32(8 * k) for k in range(4)])
    one = _CRC[one & 255] ^ (one >> 8)
    out = [one]
    for _ in range(31):
        out.append(np.stack([_apply(out[-1], row) for row in out[-1]]))
    return out


_ZEROS = _zeros()


def crc_before(crc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What crc, of some bytes, adds to the CRC of `sizes` bytes that follow them: the CRC of both is the exclusive or."""
    crc = crc.copy()
    for k in range(int(sizes.max(initial=0)).bit_length()):
        at = np.flatnonzero(sizes >> k & 1)
        crc[at] = _apply(_ZEROS[k], crc[at])
    return crc


def word_crcs(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of each word, and of the word after a space."""
    long = np.flatnonzero(size > SHORT)
    order = np.argsort(size, kind="stable")[: len(size) - len(long)]
    starts, sizes = start[order], size[order]
    blank = _CRC[(0xFFFFFFFF ^ 32) & 255] ^ np.uint32(0xFFFFFFFF >> 8)
    states = [np.full(len(order), s, np.uint32) for s in (0xFFFFFFFF, blank)]
    for k in range(int(sizes[-1]) if len(sizes) else 0):
        at = int(np.searchsorted(sizes, k, "right"))  # words from here on have more bytes
        byte = raw[starts[at:] + k]
        for s in states:
            s[at:] = _CRC[(s[at:] ^ byte) & 255] ^ (s[at:] >> 8)
    out = [np.empty(len(size), np.uint32) for _ in states]
    for o, s in zip(out, states, strict=True):
        o[order] = ~s
    for i in long.tolist():
        word = raw[start[i] : start[i] + size[i]].tobytes()
        out[0][i], out[1][i] = zlib.crc32(word), zlib.crc32(b" " + word)
    return out[0], out[1]


def features(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a string array: the document and the bucket of every feature, and the number of words of each document."""
    raw, off = text_buffer(texts)
    raw = _LOWER[raw]
    solid = _LETTER[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(solid & (edge[:-1] | ~np.concatenate([[False], solid[:-1]])))
    end = np.flatnonzero(solid & (edge[1:] | ~np.concatenate([solid[1:], [False]]))) + 1
    words = np.diff(np.searchsorted(start, off))
    doc = np.repeat(np.arange(len(words)), words)
    one, after = word_crcs(raw, start, end - start)
    size = end - start + 1
    docs, crcs, crc = [doc], [one], one
    for n in range(1, LONGEST):  # a run of n words and the one after it
        crc = crc_before(crc[:-1], size[n:]) ^ after[n:]
        same = np.flatnonzero(doc[:-n] == doc[n:]) if n < len(doc) else np.zeros(0, np.int64)
        docs.append(doc[same])
        crcs.append(crc[same])
    return np.concatenate(docs), (np.concatenate(crcs) % np.uint32(buckets)).astype(np.int64), words


def bucket_counts(texts: DataFrame, column: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How often all texts hold a feature of each bucket."""

    def run(batches):
        own = np.zeros(buckets, np.int64)
        for batch in batches:
            for i, j in slices(batch.column(0)):
                own += np.bincount(features(batch.column(0).slice(i, j - i), buckets)[1], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], ["counts"])

    vectors = texts.select(F.col(f"`{column}`").cast("string").alias("text")).mapInArrow(trimmed(run), "counts binary").rdd
    if not vectors.getNumPartitions():
        return np.zeros(buckets, np.int64)
    # a third level where two would still send the driver more than a few hundred vectors
    depth = 2 if vectors.getNumPartitions() <= 1 << 17 else 3
    return vectors.map(lambda r: np.frombuffer(r[0], np.int64)).treeReduce(lambda a, b: a + b, depth)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket: floor(1000 ln) of its smoothed share in the target over that in the source."""
    n = len(source)
    all_s, all_t = float(source.sum()) + n, float(target.sum()) + n
    return np.array([math.floor(1000 * math.log((t + 1) * all_s / ((s + 1) * all_t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(doc_id: int, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "doc_id long, n_features long, weight long, score long, eligible boolean"


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, eligible) of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(gain.astype(np.float64))  # exact: gains are small whole numbers

    def run(batches):
        for batch in batches:
            for i, j in slices(batch.column(1)):
                doc, bucket, words = features(batch.column(1).slice(i, j - i), len(shared.value))
                n = np.bincount(doc, minlength=len(words))
                weight = np.bincount(doc, weights=shared.value[bucket], minlength=len(words)).astype(np.int64)
                ids = batch.column(0).slice(i, j - i)
                score = [None if d is None else w + gumbel(d, seed) for d, w in zip(ids.to_pylist(), weight.tolist(), strict=True)]
                eligible = [d is not None and w >= least_words for d, w in zip(ids.to_pylist(), words.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(weight), pa.array(score, pa.int64()), pa.array(eligible, pa.bool_())], [x.split()[0] for x in SCORED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), SCORED)


def in_order(rows: DataFrame, *order) -> DataFrame:
    """rows with their place (from 1) in an order of all: ranges of the order, places in them, and the numbers of rows before."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "in-order", 10_000)
    part = F.shiftright("_id", 33)
    before, bases = 0, {}
    for r in sorted(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):  # a row for each range
        bases[r["part"]] = before
        before += r["n"]
    if not bases:
        return placed.withColumn("place", F.col("_id")).drop("_id")
    ranges = placed.sparkSession.createDataFrame(list(bases.items()), "_part long, _base long")
    place = F.col("_base") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn("_part", part).join(F.broadcast(ranges), "_part").withColumn("place", place).drop("_id", "_part", "_base")


def drawn(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Scored rows with rank: their places among the highest scores, floor(percent * N / 100) of N eligible rows; others null."""
    eligible = F.col("eligible")
    rows = materialize(rows, "scored")  # ranges are found by a pass of their own
    placed = in_order(rows, eligible.desc(), F.col("score").desc(), "doc_id", "n_features", "weight")
    most = percent * placed.filter(eligible).count() // 100
    return placed.withColumn("rank", F.when(eligible & (F.col("place") <= most), F.col("place"))).drop("place", "eligible")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of docs (doc_id, text), drawn towards the texts of target (text)."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    return drawn(scored(docs, gain, seed), percent)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the texts of benchmark."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORACLE = f"""
WITH w AS (SELECT 1 AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents
  UNION ALL SELECT 2, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') FROM benchmark),
f AS (SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS feature FROM w),
n AS (SELECT side, id, feature, count(*) AS n FROM f GROUP BY ALL),
crc AS (SELECT feature, {crc_sql('digits', 'crcs')} % 10000 AS bucket FROM (SELECT DISTINCT feature, hex(encode(feature)) AS digits FROM n), (SELECT {CRC_TABLE_SQL} AS crcs)),
b AS (SELECT side, id, bucket, CAST(sum(n) AS BIGINT) AS n FROM n JOIN crc USING (feature) GROUP BY ALL),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (side = 1), 0) AS s, coalesce(sum(n) FILTER (side = 2), 0) AS t FROM b GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (sum(s) OVER () + 10000) AS DOUBLE) / CAST((s + 1) * (sum(t) OVER () + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM sums),
weights AS (SELECT id, sum(n) AS n_features, sum(n * gain) AS weight FROM b JOIN g USING (bucket) WHERE side = 1 GROUP BY id),
scored AS (SELECT w.id AS doc_id, len(w.w) AS words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || w.id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM w LEFT JOIN weights ON weights.id = w.id WHERE side = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY words >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) FILTER (words >= {LEAST_WORDS}) OVER () AS all_eligible FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= {LEAST_WORDS} AND place <= {PERCENT} * all_eligible // 100 THEN place END AS rank FROM ranked
"""

"""Importance resampling against counting feature by feature."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpuscle.llm import resampling as R

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    """The features' buckets, and the number of words."""
    words = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    return [zlib.crc32(b" ".join(words[i : i + n])) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)], len(words)


def brute(docs, target):
    own = [plain(t) for _, t in docs]
    s, t = Counter(b for f, _ in own for b in f), Counter(b for x in target for b in plain(x)[0])
    all_s, all_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(10_000)]
    out = []
    for (d, _), (f, words) in zip(docs, own, strict=True):
        weight = sum(gain[b] for b in f)
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(f), weight, score, None, d is not None and words >= 20])
    best = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0], r[1], r[2]))
    for rank, r in enumerate(best[: 5 * len(best) // 100], 1):
        r[4] = rank
    return Counter(tuple(r[:5]) for r in out)


def texts(n, seed=3):
    rnd = random.Random(seed)
    words = ["The", "of", "ÉCOLE", "日本語" * 30, "x" * 31, "x" * 32, "x" * 33, "y" * 400, "a1", "B-2", "it's", "\x7f", "\x00", "Σ", "end."]
    return [" ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 2, 3, 19, 20, 21, 60]))) for _ in range(n)]


def test_features():
    some = [*texts(300), "", None, "a", "a b", "a b c"]
    doc, bucket, words = R.features(pa.array(some))
    got = [Counter() for _ in some]
    for d, b in zip(doc.tolist(), bucket.tolist(), strict=True):
        got[d][b] += 1
    want = [plain(t) for t in some]
    assert got == [Counter(f) for f, _ in want]
    assert words.tolist() == [n for _, n in want]


@pytest.mark.parametrize("none", [[], [None, ""]])
def test_no_words(none):
    doc, bucket, words = R.features(pa.array(none, pa.string()))
    assert len(doc) == len(bucket) == 0 and words.tolist() == [0] * len(none)


def test_against_brute_force(spark):
    rows = list(enumerate(texts(500))) + [(None, "w " * 50), (7, "w " * 50), (7, "w " * 50), (900, None), (901, "common words " * 20_000)]
    target = [*texts(20, seed=4), None]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").repartition(5)
    got = R.resample(docs, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    want = brute(rows, target)
    assert Counter(map(tuple, got)) == want
    assert sum(r["rank"] is not None for r in got) > 5


def test_no_target(spark):
    rows = list(enumerate(texts(100)))
    got = R.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "text string"))
    assert Counter(map(tuple, got.collect())) == brute(rows, [])


def test_counts_of_no_rows(spark):
    assert not R.bucket_counts(spark.createDataFrame([], "text string")).any()


def test_places_over_ranges(spark):
    rows = spark.range(5000).selectExpr("id % 7 AS k", "id")
    got = R.in_order(rows, "k", "id").orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, 5001))
    assert [(r["k"], r["id"]) for r in got] == sorted((i % 7, i) for i in range(5000))


def test_crc_of_joined_bytes():
    rnd = np.random.default_rng(5)
    pairs = [(rnd.bytes(int(a)), rnd.bytes(int(b))) for a, b in rnd.integers(0, 3000, (50, 2))]
    first = np.array([zlib.crc32(a) for a, _ in pairs], np.uint32)
    second = np.array([zlib.crc32(b) for _, b in pairs], np.uint32)
    sizes = np.array([len(b) for _, b in pairs])
    assert (R.crc_before(first, sizes) ^ second).tolist() == [zlib.crc32(a + b) for a, b in pairs]

"""Yinyang clustering against comparing every vector with every centroid."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from corpuscle.llm import centroids as C


def plain(rows, k=16, rounds=3, dimensions=64):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    hashed = sorted((i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept)
    centroids = [v for *_, v in hashed[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for r in range(rounds + 1):
        of = [min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c)) for _, v in kept]
        if r == rounds:
            break
        for c in range(len(centroids)):
            own = [v for (_, v), o in zip(kept, of, strict=True) if o == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    d = [far(v, centroids[o]) for (_, v), o in zip(kept, of, strict=True)]
    inertia = Counter()
    for o, x in zip(of, d, strict=True):
        inertia[o] += x
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, o, x, inertia[o], sum(d), digest[o]) for (i, _), o, x in zip(kept, of, d, strict=True))


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster string").repartition(3)


def check(spark, rows, **options):
    got = C.clustered(frame(spark, rows), **options).collect()
    assert Counter(map(tuple, got)) == plain([(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows], **{k: v for k, v in options.items() if k != "groups"})
    return got


@pytest.mark.parametrize("groups", [1, 4, 16])
def test_against_brute_force(spark, groups):
    rnd = np.random.default_rng(1)
    middles = rnd.normal(0, 1, (10, 64))
    rows = [(i, (middles[i % 10] + rnd.normal(0, 0.4, 64)).tolist()) for i in range(400)]
    odd = [(1000, None), (1001, [1.0] * 63), (1002, [None] + [1.0] * 63), (1003, [float("nan")] * 64), (1004, [float("inf")] * 64), (1005, []), (None, rows[3][1]), (5, rows[5][1]), (5, rows[6][1])]
    assert len(check(spark, rows + odd, groups=groups)) == 403


def test_ties_go_to_the_smaller_number(spark):
    """Few values and many equal vectors: distances tie all the time."""
    rnd = np.random.default_rng(2)
    rows = [(i, np.repeat(rnd.integers(-1, 2, 4) / 64, 16).tolist()) for i in range(300)]
    check(spark, rows)


def test_fewer_vectors_than_centroids(spark):
    check(spark, [(i, [float(i)] * 64) for i in range(5)])


@pytest.mark.parametrize("rounds", [0, 1, 6])
def test_rounds_and_sizes(spark, rounds):
    rnd = np.random.default_rng(3)
    check(spark, [(i, rnd.normal(0, 1, 3).tolist()) for i in range(200)], k=7, rounds=rounds, dimensions=3, groups=3)


def test_bounds_hold_and_save_work():
    """Over moves of centroids: results of a full scan, bounds that are none too tight, few distances."""
    rnd = np.random.default_rng(4)
    middles = rnd.integers(-500, 500, (16, 8))
    v = (middles[rnd.integers(0, 16, 3000)] + rnd.integers(-20, 20, (3000, 8))).astype(np.int64)
    c = v[:16].copy()
    group = C.grouped(c, 4)
    state = np.full(len(v), -1), np.zeros(len(v)), np.zeros((len(v), group.max() + 1))
    work = []
    for _ in range(8):
        cluster, upper, lower, n = C.nearest(v, c, group, *state)
        work.append(n)
        d = ((v[:, None] - c[None]) ** 2).sum(2)
        assert (cluster == d.argmin(1)).all()
        assert (upper >= np.sqrt(d[np.arange(len(v)), cluster])).all()
        for g in range(lower.shape[1]):
            others = np.where((group == g)[None] & (np.arange(16)[None] != cluster[:, None]), np.sqrt(d), np.inf).min(1)
            assert (lower[:, g] <= others + 1e-9).all()
        new = np.array([v[cluster == k].sum(0) // (cluster == k).sum() if (cluster == k).any() else c[k] for k in range(16)])
        drift = np.sqrt(((new - c) ** 2).sum(1))
        state = cluster, upper + drift[cluster], lower - np.array([drift[group == g].max() for g in range(lower.shape[1])])
        c = new
    assert work[0] == 16 * len(v) and min(work) < len(v)


def test_sums_beyond_longs_and_large_components(spark):
    rows = [(i, [float(2**20 * (i % 3 - 1))] * 64) for i in range(40)]
    check(spark, rows)
    assert C.whole_vectors(frame(spark, [(1, [3e38] * 64), (2, [1.0] * 64)])).count() == 1

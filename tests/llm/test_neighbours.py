from __future__ import annotations

import numpy as np
import pytest

from corpuscle.llm import neighbours as N


def table(spark, vectors, ids=None):
    rows = [(int(i), None if v is None else [float(x) for x in v]) for i, v in zip(ids if ids is not None else range(len(vectors)), vectors, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute(vectors, ids, every=50, k=5):
    out = {}
    v = np.asarray(vectors, np.float32).astype(float)
    ids = np.asarray(ids)
    for q in np.flatnonzero(ids % every == 0):
        s = (v @ v[q]) / np.sqrt((v * v).sum(1) * (v[q] * v[q]).sum())
        s[ids == ids[q]] = -9
        out[int(ids[q])] = [(int(ids[i]), s[i]) for i in np.lexsort((ids, -s.round(12)))[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    assert set(got) == set(want)
    assert all(len(got[q]) == len(want[q]) for q in want)
    for q in got:
        exact = dict(want[q])
        assert all(abs(s - exact[i]) < 1e-12 for i, s in got[q] if i in exact)
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want])


def clustered(n, dim, each, seed, noise=0.35):
    r = np.random.default_rng(seed)
    return r.standard_normal((n // each, dim))[r.integers(0, n // each, n)] + noise * r.standard_normal((n, dim))


def test_few_vectors_with_copies(spark):
    r = np.random.default_rng(1)
    v = r.standard_normal((300, 8))
    v[10:25] = v[0]  # more copies than a list holds
    got, want = found(N.nearest(table(spark, v))), brute(v, range(300))
    assert recall(got, want) >= 0.9
    assert got[0] == [(i, 1.0) for i in range(10, 15)]


@pytest.mark.parametrize("kind", ["random", "clustered"])
def test_recall(spark, kind):
    v = clustered(3000, 32, 30, 2) if kind == "clustered" else np.random.default_rng(2).standard_normal((3000, 32))
    assert recall(found(N.nearest(table(spark, v))), brute(v, range(3000))) >= 0.9


@pytest.mark.parametrize(("kind", "most"), [("random", 2.0), ("clustered", 0.1)])
def test_buckets_are_hashed_at_every_size_and_few_are_visited_among_neighbours(spark, kind, most):
    v = clustered(4000, 64, 20, 3) if kind == "clustered" else np.random.default_rng(3).standard_normal((4000, 64))
    entries, _ = N.distinct_vectors(table(spark, v))
    hashes, reached, share = N.fitted(entries.cache(), "<f4", 4000)
    assert hashes.m > 0 and reached >= N.RECALL and share < most
    unit = N._unit(v)
    q = np.arange(0, 4000, 50)
    own, seen = hashes.index(unit), hashes.visit(unit[q])
    at = np.zeros((len(q), len(v)), bool)
    for t in range(hashes.tables):
        at |= np.array([np.isin(own[:, t], s) for s in seen[:, t]])
    near = unit[q] @ unit.T
    near[np.arange(len(q)), q] = -2
    best = np.argsort(-near, 1)[:, :5]
    assert np.take_along_axis(at, best, 1).mean() >= 0.9
    assert at.mean() < min(most, 0.99)


def test_more_vectors_are_hashed_finer():
    """The more vectors there are, the smaller the share of them that a query scores, at the same recall."""
    v = N._unit(clustered(20_000, 64, 20, 4))
    asks = v[::400]
    near = asks @ v.T
    near[near > 1 - 1e-9] = -2
    true = [v[np.argsort(-x)[:5]] for x in near]
    fits = [N.fit(asks, true, v[1::20], n, n // 50) for n in (2000, 20_000, 2_000_000, 2_000_000_000)]
    shares = [share for _, _, share in fits]
    assert shares == sorted(shares, reverse=True) and shares[1] < 0.1 and shares[2] < 0.02 and shares[3] < 0.005
    assert all(reached >= N.RECALL for _, reached, _ in fits)


def test_cells_of_many_vectors_and_queries_are_split(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 40)
    monkeypatch.setattr(N, "ASKS", 2)
    r = np.random.default_rng(3)
    v = np.concatenate([r.standard_normal((300, 6)), 1e-3 * r.standard_normal((300, 6)) + np.ones(6)])  # half of all in few buckets
    want = brute(v, range(600), 10)
    assert recall(found(N.nearest(table(spark, v), 10)), want) >= 0.9
    cells = N.placed(N.distinct_vectors(table(spark, v), 10)[0], N.Hashes(2, 4, 2, 2.5), "<f4", 600)
    dealt = N.in_blocks(cells).groupBy("cell", "probe", "block", "asks").count().collect()
    assert max(d["count"] for d in dealt if not d["asks"]) < 80 and max(d["count"] for d in dealt if d["asks"]) < 12


def test_rows_of_very_different_length():
    a = np.array([[1e-200, 2e-200], [1.0, 2.0], [1e200, 3e200]])
    assert N.cosine(a, a) == pytest.approx([1, 1, 1], abs=1e-15)
    assert N.cosine(a[:1], a[1:2])[0] == N.cosine(a, a[[1, 1, 1]])[0]


def test_odd_vectors(spark):
    rows = [[1, 0], [1, 0], None, [0, 0], [float("nan"), 1], [float("inf"), 1], [2, 0], [1, 1, 1], [0, 1]]
    ids = [0, 3, 50, 100, 150, 200, 2, 250, 300]
    got = found(N.nearest(table(spark, rows, ids)))
    assert got == {0: [(2, 1.0), (3, 1.0), (300, 0.0)], 300: [(0, 0.0), (2, 0.0), (3, 0.0)]}  # 250 is alone in its dimension


def test_probe_order():
    sets = N.templates(6, 200)
    z = np.sort(np.random.default_rng(0).uniform(0, 1, (50, 12)), 1)
    assert not sets[0].any() and len({tuple(s) for s in sets}) == len(sets)
    for s in sets:  # no hash is moved both ways
        at = np.flatnonzero(s)
        assert len({min(i, 11 - i) for i in at}) == len(at)
    assert (z @ sets.T).mean(0)[:20].mean() < (z @ sets.T).mean(0)[-20:].mean()

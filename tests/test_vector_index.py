"""Stored cells and block joins against comparing all vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.operators import blocks as K
from corpuscle.operators import vector_index as V
from corpuscle.operators.vectors import rank

DOCS = "id long, corpus_pos long, embedding array<float>, label int"


def brute(docs, queries, top_n, by_label=False):
    out = set()
    rows = [(i, pos, np.array(v, np.float32).astype(float), label) for i, pos, v, label in docs if v and None not in v]
    for q, v, label in queries:
        if not v or None in v:
            continue
        v = np.array(v, np.float32).astype(float)
        norm = lambda x: x / (np.linalg.norm(x) or 1)
        scores = [(-round(float(norm(x) @ norm(v)), 5) + 0.0, pos, i) for i, pos, x, own in rows if len(x) == len(v) and (not by_label or own == label)]
        out |= {(q, i, n, -s + 0.0) for n, (s, _, i) in enumerate(sorted(scores)[:top_n], 1)}
    return out


def clusters(n, k, seed=1, spread=0.08, dim=16):
    rnd = np.random.default_rng(seed)
    middles = rnd.normal(0, 1, (k, dim))
    middles /= np.linalg.norm(middles, axis=1, keepdims=True)
    return [(i, (i * 37) % (n * 2), (middles[i % k] + rnd.normal(0, spread, dim)).astype(np.float32).tolist(), i % 3 if i % 11 else None) for i in range(n)]


def frames(spark, docs, queries):
    return spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(queries, "query_id long, embedding array<float>, label int").repartition(3)


def got(df):
    return {(r["query_id"], r["id"], r["rank"], r["score"] + 0.0) for r in df.collect()}


ODD = [(5000, 1, None, 0), (5001, 2, [], 1), (5002, 3, [None] * 16, 1), (5003, 4, [1.0, 2.0], 1), (5004, 5, [0.0] * 16, 0), (5005, 6, [0.0] * 16, None)]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    docs = clusters(3000, 40) + ODD
    queries = [(i, v, label) for i, _, v, label in docs[:3000:60]] + [(9000, None, 1), (9001, [0.0] * 16, 1), (9002, [1.0], 1), (9003, docs[5][2], 77)]
    rows, asked = frames(spark, docs, queries)
    index = V.VectorIndex(spark, f"file://{tmp_path_factory.mktemp('v')}/i")
    index.build(rows, 40, facet="label")
    return docs, queries, index, asked


def test_exact_search(built):
    docs, queries, index, asked = built
    own = [q for q in queries if q[1] and len(q[1]) == 16]
    assert got(index.search(asked, 7, facet="label")) == brute([d for d in docs if d[2] and len(d[2]) == 16], own, 7, by_label=True)


def test_search_without_facets(spark, tmp_path, built):
    docs, queries, _, asked = built
    index = V.VectorIndex(spark, f"file://{tmp_path}/i")
    index.build(spark.createDataFrame(docs, DOCS), 40)
    own = [q for q in queries if q[1] and len(q[1]) == 16]
    want = brute([d for d in docs if d[2] and len(d[2]) == 16], own, 10)
    assert got(index.search(asked, 10)) == want
    found = got(index.search(asked, 10, mode="probe", probes=4))
    some = {(q, i) for q, i, *_ in want if q < 9000}
    assert len(some & {(q, i) for q, i, *_ in found}) >= 0.9 * len(some)  # recall
    for mode in ("probe", "exact"):
        r = index.reading(asked.filter("query_id < 9000"), 10, mode=mode).agg(F.sum("cells"), F.sum("cells_read"), F.sum("vectors"), F.sum("vectors_read")).first()
        assert r[1] < 0.2 * r[0] and r[3] < 0.2 * r[2]


def test_vectors_without_neighbours(spark, tmp_path):
    """Random directions: the bounds tell little, and the result is exact all the same."""
    rnd = np.random.default_rng(3)
    docs = [(i, i, rnd.normal(0, 1, 24).astype(np.float32).tolist(), 0) for i in range(600)]
    queries = [(i, docs[i][2], 0) for i in range(0, 600, 50)]
    rows, asked = frames(spark, docs, queries)
    index = V.VectorIndex(spark, f"file://{tmp_path}/i")
    index.build(rows, 12)
    assert got(index.search(asked, 5, probes=1)) == brute(docs, queries, 5)


def test_copies_and_few_vectors(spark, tmp_path):
    docs = [(i, 100 - i, [1.0, 2.0, 3.0], 1) for i in range(50)] + [(60, 0, [1.0, 0.0, 0.0], 1)]
    rows, asked = frames(spark, docs, [(1, [1.0, 2.0, 3.0], 1)])
    index = V.VectorIndex(spark, f"file://{tmp_path}/i")
    index.build(rows, 8)
    assert got(index.search(asked, 60)) == brute(docs, [(1, [1.0, 2.0, 3.0], 1)], 60)
    empty = V.VectorIndex(spark, f"file://{tmp_path}/e")
    empty.build(rows.limit(0), 8)
    assert got(empty.search(asked, 3)) == set()


@pytest.mark.parametrize("keys", [[], ["label"]])
def test_block_joins(spark, monkeypatch, keys):
    docs = clusters(900, 9, seed=5) + ODD
    queries = [(i, v, label) for i, _, v, label in docs[:900:17]] + [(9000, None, 1), (9002, [1.0, 1.0], 1), (9003, docs[5][2], 77)]
    rows, asked = frames(spark, docs, queries)
    monkeypatch.setattr(K, "QUERIES", 10)
    found = got(rank(K.best(K.blocks(rows, keys, 64), asked, keys, 6), 6))
    if keys:  # a join leaves null keys out
        docs, queries = [d for d in docs if d[3] is not None], [q for q in queries if q[2] is not None]
    assert found == brute(docs, queries, 6, by_label=bool(keys))


def test_cells_cover_the_sample():
    v = np.random.default_rng(1).normal(0, 1, (500, 8))
    c = V.learnt(v, 20)
    assert c.shape == (20, 8) and np.allclose(np.linalg.norm(c, axis=1), 1)
    assert set((K.unit(v, 8) @ c.T).argmax(1)) == set(range(20))

"""Facets, BM25, vectors, fusion, metrics."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from corpuscle.operators import bm25, evaluate, facets, fusion, retrieve, vectors

ROWS = [
    (1, "国家法律", "", ""),
    (2, "行政法规", "", ""),
    (3, "地方法规", "甲省", ""),
    (4, "地方法规", "甲省", "乙市"),
    (5, "地方法规", "丙省", "丁市"),
    (6, None, None, None),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id int, file_type string, region string, city string")


@pytest.mark.parametrize(
    ("types", "provinces", "cities", "want"),
    [
        (None, None, None, {1, 2, 3, 4, 5, 6}),
        (None, [], [], {1, 2, 3, 4, 5, 6}),
        ([], None, None, set()),
        ([], ["甲省"], ["乙市"], set()),
        (None, ["甲省"], None, {1, 3}),  # rows of a city ignore provinces
        (None, None, ["乙市"], {1, 4}),
        (None, ["甲省"], ["丁市"], {1, 3, 5}),
        (["国家法律"], None, None, {1}),
        (["地方法规"], None, None, {3, 4, 5}),
        (["地方法规"], ["甲省"], None, {3}),  # national rows need their type
        (["国家法律", "地方法规"], ["甲省"], ["乙市"], {1, 3, 4}),
        (["行政法规"], ["甲省"], None, set()),  # nationwide rows of other types have no region
    ],
)
def test_facets(rows, types, provinces, cities, want):
    assert {r["id"] for r in facets.facet_filter(rows, types, provinces, cities).collect()} == want


def test_facet_candidates(spark, rows):
    queries = spark.createDataFrame([(1, None, None, None), (2, [], None, None), (3, ["地方法规"], ["甲省"], ["丁市"])], "query_id long, file_types array<string>, provinces array<string>, cities array<string>")
    got = facets.facet_candidates(rows, queries).groupBy("query_id").agg(F.sort_array(F.collect_list("id")).alias("ids")).collect()
    assert {r["query_id"]: r["ids"] for r in got} == {1: [1, 2, 3, 4, 5, 6], 3: [3, 5]}


def okapi(corpus, query, k1=1.5, b=0.75, eps=0.25):
    docs = [c.lower().split() for c in corpus]
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    raw = {t: math.log(n - x + 0.5) - math.log(x + 0.5) for t, x in df.items()}
    avg = sum(raw.values()) / len(raw)
    idf = {t: (eps * avg if v < 0 else v) for t, v in raw.items()}
    out = []
    for d in docs:
        s = 0.0
        for t in query.lower().split():
            f = d.count(t)
            s += idf.get(t, 0) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(d) / mean))
        out.append(s)
    return out


@pytest.mark.parametrize("query", ["fire door", "the fire the fire", "absent", "the", ""])
def test_bm25(spark, query):
    corpus = ["the fire door", "the open door", "the fire fire exit", "the quiet room", "a smoke alarm in the hall"]
    table = spark.createDataFrame([(f"c{i}", i, t) for i, t in enumerate(corpus)], "id string, corpus_pos long, text string")
    q = spark.createDataFrame([(1, query)], "query_id long, text string")
    index = bm25.build(table)
    got = bm25.rank(bm25.score(q, index), index, 4, query_ids=q).orderBy("rank").collect()
    want = okapi(corpus, query)
    order = sorted(range(len(corpus)), key=lambda i: (-round(want[i], 5), i))[:4]
    assert [r["id"] for r in got] == [f"c{i}" for i in order]
    assert [r["score"] for r in got] == pytest.approx([round(want[i], 5) for i in order], abs=2e-5)


def test_bm25_keeps_corpus_statistics_under_a_filter(spark):
    corpus = ["fire door", "fire exit", "fire hall", "smoke"]
    table = spark.createDataFrame([(i, i, t) for i, t in enumerate(corpus)], "id int, corpus_pos long, text string")
    q = spark.createDataFrame([(1, "smoke fire")], "query_id long, text string")
    index = bm25.build(table)
    scores = bm25.score(q, index)
    some = spark.createDataFrame([(1, 3), (1, 0)], "query_id long, id int")
    every = {r["id"]: r["score"] for r in bm25.rank(scores, index, 9, query_ids=q).collect()}
    few = {r["id"]: r["score"] for r in bm25.rank(scores, index, 9, some).collect()}
    assert few == {i: every[i] for i in (0, 3)}


def test_vectors(spark):
    table = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 2, [2.0, 0.0]), (3, 3, [0.0, 0.0]), (4, 4, [1.0, 1.0])], "id int, corpus_pos long, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<double>")
    got = vectors.vector_rank(q, table, 4).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == [(1, 1.0), (2, 1.0), (4, 0.70711), (3, 0.0)]
    only = spark.createDataFrame([(9, 3)], "query_id long, id int")
    assert [r["id"] for r in vectors.vector_rank(q, table, 1, only).collect()] == [3]
    assert vectors.vector_rank(q, table, 1, only, mode="overfetch").count() == 0  # cut before the filter


def test_segments(spark):
    rows = [(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 1, 1, "b"), (1, 1, 2, "c"), (1, 2, 1, "d")]
    got = vectors.segment_merge(spark.createDataFrame(rows, "query_id long, segment int, rank int, id string"), 3).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["a", "b", "c"]
    docs = spark.createDataFrame([(1, "x " * 512), (2, "x " * 1000), (3, None)], "query_id long, text string")
    cut = vectors.query_segments(docs, lambda c: F.filter(F.split(c, " "), lambda x: x != "")).select("query_id", "segment", F.size("tokens").alias("n")).collect()
    assert sorted(map(tuple, cut)) == [(1, 0, 512), (2, 0, 480), (2, 1, 480), (2, 2, 40), (3, 0, 0)]


def test_rrf(spark):
    lists = [spark.createDataFrame([(1, i, r) for r, i in enumerate(ids, 1)], "query_id long, id string, rank int") for ids in (["a", "b", "c"], ["c", "d"])]
    got = fusion.rrf(lists, 9).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["c", "a", "b", "d"]  # b and d tie; b was seen first
    assert got[0]["score"] == pytest.approx(1 / 63 + 1 / 61, abs=1e-5)
    assert [r["id"] for r in fusion.rrf([lists[0], lists[1].limit(0)], 2).orderBy("rank").collect()] == ["a", "b"]


def test_rerank_and_citations(spark):
    pool = spark.createDataFrame([(1, "fire door", "c1", "no match", 1, "s1"), (1, "fire door", "c2", "the door", 2, "s2"), (1, "fire door", "c3", "fire door", 3, "s3")], "query_id long, query string, id string, text string, rank int, source string")
    got = fusion.rerank(pool).orderBy("rank")
    assert [(r["id"], r["score"]) for r in got.collect()] == [("c3", 1.0), ("c2", 0.5), ("c1", 0.0)]
    assert fusion.rerank(pool, available=False) is pool
    cited = fusion.citations(got.filter("rank <= 2")).first()
    assert cited["context"] == "[1]（s3）fire door\n[2]（s2）the door"
    assert cited["sources"] == ["[1] s3 fire door", "[2] s2 the door"]
    model = fusion.model_scorer(lambda: lambda q, t: [float(len(x)) for x in t])
    assert [r["id"] for r in fusion.rerank(pool, model).orderBy("rank").collect()] == ["c3", "c1", "c2"]


def test_metrics(spark):
    queries = spark.createDataFrame([(1, "short", ["a", "b"]), (2, "short", []), (3, "long", ["z"])], "query_id long, kind string, gold array<string>")
    found = spark.createDataFrame([(1, 1, "x"), (1, 2, "a"), (1, 3, "a"), (1, 6, "b"), (3, 1, "z"), (2, 1, "a")], "query_id long, rank int, source string")
    per = {r["query_id"]: r for r in evaluate.query_metrics(queries, found, 5).collect()}
    assert (per[1]["hit"], per[1]["recall"], per[1]["precision"], per[1]["rr"]) == (1.0, 0.5, 0.2, 0.5)
    assert (per[2]["hit"], per[2]["recall"], per[2]["rr"]) == (0.0, 0.0, 0.0)
    total = {r["kind"]: r for r in evaluate.evaluate(queries, found, 5).collect()}
    assert total["short"]["n"] == 2 and total["all"]["n"] == 3
    assert total["all"]["hit"] == pytest.approx(0.6667) and total["all"]["mrr"] == pytest.approx(0.5)
    assert evaluate.report(evaluate.evaluate(queries, found, 5), 5).collect()[0]["value"].startswith("all")
    assert evaluate.sample(queries, 2).count() == 2


def test_retrieve(spark):
    chunks = spark.createDataFrame([("a#001", 1, "fire door", "a", "国家法律", "", "", [1.0, 0.0]), ("b#001", 2, "fire exit", "b", "地方法规", "甲省", "", [0.0, 1.0]), ("c#001", 3, "quiet", "c", "地方法规", "丙省", "", [0.9, 0.1])], "id string, corpus_pos long, text string, source string, file_type string, region string, city string, embedding array<double>")
    corpus = retrieve.Corpus(chunks)
    q = spark.createDataFrame([(1, "fire exit", [1.0, 0.0], None, None, None), (2, "fire", [0.0, 1.0], ["地方法规"], ["甲省"], None)], "query_id long, text string, embedding array<double>, file_types array<string>, provinces array<string>, cities array<string>")
    got = retrieve.retrieve(q, corpus, top_k=2).orderBy("query_id", "rank").collect()
    assert [r["id"] for r in got if r["query_id"] == 2] == ["b#001"]
    assert len([r for r in got if r["query_id"] == 1]) == 2
    reranked = retrieve.retrieve(q, corpus, top_k=1, scorer=fusion.lexical_overlap).collect()
    assert {r["query_id"]: r["id"] for r in reranked} == {1: "b#001", 2: "b#001"}
    shown = retrieve.retrieve(q, corpus, top_k=3, visible=spark.createDataFrame([("c",)], "source string")).collect()
    assert {r["id"] for r in shown} == {"c#001"}
    none, why = retrieve.retrieve_or_empty(q.drop("text"), corpus)
    assert none.count() == 0 and why
    corpus.reset()


def test_a_task_keeps_the_best_of_all_its_batches():
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from corpuscle.operators import bm25

    def batch(first):
        n = 700
        return pa.record_batch({"id": list(range(first, first + n)), "corpus_pos": list(range(first, first + n)), "tokens": [["a"] * (i % 7) + ["b"] for i in range(n)]})

    shared = SimpleNamespace(value=(3.0, [([5, 6], ["a", "b"], np.array([[1.0, 0.0], [0.0, 1.0]]))]))
    out = list(bm25._best(iter([batch(0), batch(1000)]), shared, 3, 5, 1.5, 0.75))
    rows = [(r["query_id"], r["id"]) for b in out for r in b.to_pylist()]
    assert len(rows) == 6 and [i for q, i in rows if q == 5] == [6, 13, 20] and [i for q, i in rows if q == 6] == [0, 7, 14]

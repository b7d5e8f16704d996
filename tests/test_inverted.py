"""The stored inverted index against BM25 built anew over the documents that are left."""

from __future__ import annotations

import math
import random
from collections import Counter

from corpuscle.operators import inverted as I

WORDS = ["safety", "rule", "fire", "the", "of", "a", "gas", "plant", "permit", "worker", "zinc", "boiler"]


def brute(docs, queries, top_n):
    """docs: {id: (pos, text)}"""
    own = {i: (t or "").split() for i, (_, t) in docs.items()}
    n, mean = len(own), sum(map(len, own.values())) / max(len(own), 1)
    df = Counter(w for d in own.values() for w in set(d))
    raw = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w, k in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    out = set()
    for q, text in queries:
        scores = []
        for i, d in own.items():
            tf = Counter(d)
            scores.append((-round(sum(idf.get(w, 0) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(d) / mean)) for w in (text or "").split()), 5) + 0.0, docs[i][0], i))
        out |= {(q, i, rank, -s + 0.0) for rank, (s, _, i) in enumerate(sorted(scores)[:top_n], 1)}
    return out


def found(index, spark, queries, top_n, version=None):
    asked = spark.createDataFrame(queries, "query_id long, text string")
    return {(r["query_id"], r["id"], r["rank"], r["score"] + 0.0) for r in index.search(asked, top_n, version).collect()}


def corpus(spark, docs, sources):
    return spark.createDataFrame([(i, pos, sources[i], t) for i, (pos, t) in docs.items()], "id long, corpus_pos long, source string, text string").repartition(3)


def random_docs(rnd, ids):
    weights = [1 / (k + 1) for k in range(len(WORDS))]
    return {i: (1000 - i, " ".join(rnd.choices(WORDS, weights, k=rnd.choice([0, 1, 3, 8, 40])))) for i in ids}


QUERIES = [(1, "fire permit"), (2, "zinc boiler zinc"), (3, "the of"), (4, "unknown"), (5, None), (6, "safety rule the worker gas"), (7, "boiler")]


def test_upsert_delete_merge(spark, tmp_path):
    rnd = random.Random(1)
    index = I.Inverted(spark, f"file://{tmp_path}/i", block=4)
    assert found(index, spark, QUERIES, 3) == set()
    docs, sources = random_docs(rnd, range(200)), {i: f"s{i // 5}" for i in range(300)}
    index.upsert(corpus(spark, docs, sources))
    assert found(index, spark, QUERIES, 5) == brute(docs, QUERIES, 5)
    old = dict(docs)
    # new texts for two sources, one of which shrinks, and a new source
    new = random_docs(rnd, [*range(10, 15), 17, 18, 250, 251])
    index.upsert(corpus(spark, new, sources))
    docs = {i: d for i, d in docs.items() if sources[i] not in ("s2", "s3")} | new
    assert found(index, spark, QUERIES, 5) == brute(docs, QUERIES, 5)
    index.delete(spark.createDataFrame([("s0",), ("s7",), ("none",)], "source string"))
    docs = {i: d for i, d in docs.items() if sources[i] not in ("s0", "s7")}
    want = brute(docs, QUERIES, 7)
    assert found(index, spark, QUERIES, 7) == want
    assert {(r["term"], r["df"]) for r in index.terms().collect()} == set(Counter(w for _, t in docs.values() for w in set(t.split())).items())
    assert found(index, spark, QUERIES, 5, version=1) == brute(old, QUERIES, 5)
    index.merge()
    m = index.store.read()
    assert len(m["segments"]) == 1 and m["deleted"] == [] and m["n"] == len(docs)
    assert found(index, spark, QUERIES, 7) == want
    assert index.vacuum(keep=1) and found(index, spark, QUERIES, 7) == want


def test_partial_merge_keeps_other_segments(spark, tmp_path):
    rnd = random.Random(2)
    index = I.Inverted(spark, f"file://{tmp_path}/i", block=4)
    docs, sources = random_docs(rnd, range(60)), {i: f"s{i // 5}" for i in range(100)}
    index.upsert(corpus(spark, docs, sources))
    for low in (60, 70):
        new = random_docs(rnd, range(low, low + 10))
        index.upsert(corpus(spark, new, sources))
        docs |= new
    index.delete(spark.createDataFrame([("s1",), ("s13",)], "source string"))
    docs = {i: d for i, d in docs.items() if sources[i] not in ("s1", "s13")}
    large = index.store.read()["segments"][0]
    index.merge(most=2)
    m = index.store.read()
    assert len(m["segments"]) == 2 and large in m["segments"] and m["n"] == len(docs)
    assert found(index, spark, QUERIES, 6) == brute(docs, QUERIES, 6)


def test_changes_leave_other_parts_alone(spark, tmp_path):
    rnd = random.Random(3)
    index = I.Inverted(spark, f"file://{tmp_path}/i", block=4)
    sources = {i: f"s{i}" for i in range(100)}
    index.upsert(corpus(spark, random_docs(rnd, range(100)), sources))
    before = index.store.read()
    index.upsert(corpus(spark, random_docs(rnd, [5]), sources))
    after = index.store.read()
    assert after["segments"][0] == before["segments"][0] and after["segments"][1]["n"] == 1 and after["deleted"][0]["n"] == 1
    index.delete(spark.createDataFrame([("s9",)], "source string"))
    assert index.store.read()["segments"] == after["segments"]


def test_only_part_of_the_postings_is_read(spark, tmp_path, monkeypatch):
    """Rare terms decide; blocks that hold frequent terms alone can't reach the threshold."""
    rnd = random.Random(4)
    docs = {i: (i, " ".join(["the", "of"] * rnd.randrange(1, 4) + rnd.choices(WORDS[3:10], k=rnd.randrange(1, 30)) + (["zinc"] * 3 if i % 97 == 0 else []))) for i in range(2000)}
    index = I.Inverted(spark, f"file://{tmp_path}/i", block=4)
    index.upsert(corpus(spark, docs, {i: "s" for i in docs}))
    queries = [(1, "the of zinc"), (2, "zinc permit")]
    assert found(index, spark, queries, 10) == brute(docs, queries, 10)
    read = index.reading(spark.createDataFrame(queries, "query_id long, text string"), 10).collect()
    assert len(read) == 2 and all(r["blocks_read"] < 0.2 * r["blocks"] and r["postings_read"] < 0.2 * r["postings"] for r in read)
    monkeypatch.setattr(I, "FEW", 0)
    assert found(index, spark, queries, 10) == brute(docs, queries, 10)  # without bounds


def test_many_passes_of_queries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "QUERIES_AT_ONCE", 3)
    monkeypatch.setattr(I, "MOST_NAMES", 2)
    rnd = random.Random(6)
    docs = random_docs(rnd, range(120))
    index = I.Inverted(spark, f"file://{tmp_path}/i", block=4)
    index.upsert(corpus(spark, docs, {i: f"s{i}" for i in docs}))
    assert found(index, spark, QUERIES, 4) == brute(docs, QUERIES, 4)
    assert index.reading(spark.createDataFrame(QUERIES, "query_id long, text string"), 4).count() == len([q for q in QUERIES if q[1]])


def test_negative_scores(spark, tmp_path):
    """Every term is in more than half of the documents, so the mean idf is below zero and documents without a score are first."""
    docs = {i: (i, "fire the") for i in range(20)} | {i: (i, "other") for i in (20, 21)} | {30: (30, None)}
    docs |= {i: (i, "fire the other other") for i in range(40, 60)}
    index = I.Inverted(spark, f"file://{tmp_path}/i", block=4)
    index.upsert(corpus(spark, docs, {i: None for i in docs}))
    assert index.store.read()["mean_idf"] < 0
    queries = [(1, "fire"), (2, "other the"), (3, "none")]
    assert found(index, spark, queries, 8) == brute(docs, queries, 8)


def test_equal_scores_follow_positions(spark, tmp_path):
    docs = {i: ((i * 37) % 500, "fire" if i % 2 else "gas plant") for i in range(100)}
    index = I.Inverted(spark, f"file://{tmp_path}/i", block=4)
    index.upsert(corpus(spark, docs, {i: "x" for i in docs}))
    queries = [(1, "fire"), (2, "plant"), (3, "permit")]
    assert found(index, spark, queries, 12) == brute(docs, queries, 12)


def test_pairs_as_they_lie_in_memory():
    import numpy as np
    import pyarrow as pa

    from corpuscle.operators.inverted import _pairs

    rows = [np.array(x, "<i4").tobytes() for x in ([0, 1], [1, 2, 3, 4], [5, 6])]
    assert _pairs(pa.array(rows, pa.binary()).slice(1)).tolist() == [[1, 2], [3, 4], [5, 6]]
    assert _pairs(pa.chunked_array([rows[:1], rows[1:]], pa.binary())).tolist() == [[0, 1], [1, 2], [3, 4], [5, 6]]
    assert _pairs(pa.array([], pa.binary())).tolist() == []


def test_postings_are_made_once_and_read_twice(spark, tmp_path, monkeypatch):
    """Postings are written where they are made; what a search reads comes from one pass of bounds and one for the first blocks."""
    plans, parts, loads = {}, {}, []
    write, load = I.Store.write, I.Store.load

    def recorded(self, df, label, *more, **options):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        parts[label] = write(self, df, label, *more, **options)
        return parts[label]

    monkeypatch.setattr(I.Store, "write", recorded)
    monkeypatch.setattr(I.Store, "load", lambda self, names, schema: (loads.append(schema), load(self, names, schema))[1])
    docs = random_docs(random.Random(8), range(150))
    index = I.Inverted(spark, f"file://{tmp_path}/i", block=4)
    index.upsert(corpus(spark, docs, {i: "s" for i in docs}))
    assert "Exchange" not in plans["postings"]
    loads.clear()
    read = {r["query_id"]: r for r in index.reading(spark.createDataFrame(QUERIES, "query_id long, text string"), 5).collect()}
    assert loads.count(I.POSTINGS) == 2
    rows = spark.read.parquet(f"{index.store.path}/{parts['postings']}").collect()
    for q, text in QUERIES:
        if text:
            own = [r for r in rows if r["term"] in text.split()]
            assert (read[q]["blocks"], read[q]["postings"]) == (len({r["block"] for r in own}), sum(r["n"] for r in own))
            assert read[q]["blocks_read"] <= read[q]["blocks"] and read[q]["postings_read"] <= read[q]["postings"]
            assert bool(read[q]["blocks_read"]) == bool(own)


def test_blocks_of_a_batch_are_in_the_order_of_terms():
    import pyarrow as pa

    texts = ["b a", "c b", "a c", "b a"]
    columns = [pa.array([0, 1, 2, 3], pa.int64()), pa.array([2] * 4, pa.int32()), pa.array([sorted(t.split(), reverse=True) for t in texts]), pa.array([[1, 2]] * 4, pa.list_(pa.int32()))]
    (rows,) = I._blocks([pa.RecordBatch.from_arrays(columns, ["doc", "len", "terms", "tfs"])], 2)
    assert [(r["term"], r["block"], r["n"]) for r in rows.to_pylist()] == [("a", 0, 1), ("a", 2, 2), ("b", 0, 2), ("b", 2, 1), ("c", 0, 1), ("c", 2, 1)]
    assert I._pairs(rows["data"]).tolist() == [[0, 2], [0, 2], [1, 2], [0, 1], [1, 2], [1, 1], [1, 1], [0, 1]]


def test_index_deltas_reads_languages_with_the_texts(spark, small):
    from corpuscle.plans import tables

    docs = tables.corpus(spark, small, "lang")
    assert docs.columns[-1] == "lang" and docs.filter("lang = 'de'").count()
    assert "Join" not in docs._jdf.queryExecution().toString()

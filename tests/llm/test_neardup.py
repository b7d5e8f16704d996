from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuscle.llm import graph
from corpuscle.llm import neardup as N


def shingle_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return Counter()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(1, sum((a | b).values()))


def brute(texts, least=0.8):
    distinct = sorted({t for t in texts if t is not None})
    sets = [shingle_counts(t) for t in distinct]
    parent = list(range(len(distinct)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(distinct)):
        for j in range(i):
            if sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= least:
                parent[root(i)] = root(j)
    where = {t: root(i) for i, t in enumerate(distinct)}
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(("null", i) if t is None else where[t], i)
    return {i: first[("null", i) if t is None else where[t]] for i, t in enumerate(texts)}


def corpus(seed, families=25, members=6):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(3000)}"
    out = []
    for _ in range(families):
        base = [word() for _ in range(r.randint(6, 300))]
        for _ in range(members):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 40))):
                w[r.randrange(len(w))] = word()
            out.append(" ".join(w))
    out += ["a b", "a  b", "a b c", "", " ", None, None, out[0], out[0], " ".join(["x"] * 50), " ".join(["x"] * 60), " ".join(["x"] * 56)]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    docs = docs.withColumn("tid", N.text_ids(docs))
    tid = docs.select("doc_id", "tid").join(N.classes(docs), "tid", "left").collect()
    got = {r["doc_id"]: r["doc_id"] if r["class_id"] is None else r["class_id"] for r in tid}
    assert got == brute(texts)


def test_cells_join_what_leaders_miss(spark, monkeypatch):
    """A long chain of variants, in tiny blocks: links between texts that no leader is alike to."""
    monkeypatch.setattr(N, "BLOCK", 3)
    r = random.Random(5)
    base = [f"w{r.randrange(5000)}" for _ in range(120)]
    texts = []
    for i in range(40):
        base = list(base)
        base[(i * 11) % 120] = f"n{i}"
        texts.append(" ".join(base))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["class_id"] for r in N.classes(docs.withColumn("tid", N.text_ids(docs))).collect()}
    assert got == set(brute(texts).values())


def test_a_bucket_of_texts_below_the_threshold(spark):
    """Texts of one template, some 0.7 alike, share bands in great numbers; two of them are near copies."""
    r = random.Random(8)
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join([*base, *(f"d{i}x{k}" for k in range(26))]) for i in range(120)]
    texts += [texts[7] + " more", texts[90] + " words"]
    r.shuffle(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["tid"]: r["class_id"] for r in N.classes(docs.withColumn("tid", N.text_ids(docs))).collect()}
    assert sorted(got.values()) == sorted(brute(texts).values()) and len(set(got.values())) == 120


def test_bounds_leave_no_link_out():
    """A cell of all texts finds the components that pairwise comparison finds."""
    texts = [t for t in dict.fromkeys(corpus(11, 12, 8)) if t and t.split()]
    doc, element, weight, _ = N.shingles(pa.array(texts))
    sets = []
    for k in range(len(texts)):
        own, many = element[doc == k], weight[doc == k].astype(int)
        nth = np.concatenate([np.arange(n) for n in many]).astype(np.uint64)
        sets.append(np.sort((N.mix(np.repeat(own, many) + N._C[2] * nth) >> np.uint64(32)).astype(np.uint32)).tobytes())
    n = len(texts)
    sig = [np.arange(125, dtype=np.uint32).tobytes()] * n  # all share all bands
    one = {"tid": list(range(n)), "root": list(range(n)), "weight": [len(s) // 4 for s in sets], "band": [0] * n, "sig": sig, "elements": sets}
    cell = pa.table({"asks": [False] * n + [True] * n} | {c: v + v for c, v in one.items()})
    parent = list(range(n))
    for u, v in N._cell_links(cell, 0.8):
        parent = [parent[v] if x == parent[u] else x for x in parent]
    want = brute(texts)
    assert all((parent[i] == parent[j]) == (want[i] == want[j]) for i in range(n) for j in range(i))


def test_texts_with_one_hash_are_told_apart(spark, monkeypatch):
    real = F.xxhash64
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(7)) if len(c) == 1 else real(*c))
    docs = spark.createDataFrame([(i, f"text {i % 20}") for i in range(60)] + [(99, None)], "doc_id long, text string")
    got = docs.select("text", N.text_ids(docs).alias("tid")).distinct().collect()
    assert len(got) == 21 and len({r["tid"] for r in got}) == 21
    assert [r["tid"] for r in got if r["text"] is None] == [None]


def test_kept_documents(spark):
    texts = corpus(3)
    docs = spark.createDataFrame([(i, t, i, i) for i, t in enumerate(texts)], "doc_id long, text string, tid int, class_id int")
    docs = docs.union(docs.filter("doc_id = 0"))  # a repeated row
    kept = N.without_near_copies(docs)
    assert kept.columns == docs.columns
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(got) == sorted(set(brute(texts).values()))


def test_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(4)
    n, k = 400, 2000
    e = r.integers(1, 1 << 63, n).astype(np.uint64)
    a, b = r.integers(1, 9, n).astype(float), r.integers(1, 9, n).astype(float)
    b[200:] = a[200:]
    doc = np.repeat([0, 1], n)
    sig = N.signatures(doc, np.concatenate([e, e]), np.concatenate([a, b]), 2, k)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.05
    half = N.signatures(np.zeros(n, int), e, a / 4, 1, k)  # weights below one as well
    assert abs((half[0] == sig[0]).mean() - 0.25) < 0.05


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((root(u), root(v)))
        parent[b] = a
    got = {r["u"]: r["v"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0

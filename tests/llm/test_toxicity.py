from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np

from corpuscle.llm import toxicity as X

BAD = ["zorgly", "klumpf", "vexxo"]


def texts(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(r.choice(["ba", "ti", "re", "on", "the", "ll"]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(5, 120))]
        toxic = int(r.random() < 0.2)
        if toxic:
            for _ in range(r.randint(1, 3)):
                words.insert(r.randint(0, len(words)), r.choice(BAD) + r.choice(["", "ti", "on"]))
        out.append((i, " ".join(words), toxic))
    return out


def test_learns_word_families(spark):
    rows = texts(1, 1500)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, None), (9001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None), (None, 1), (99999, 1)], "doc_id long, toxic int")
    model = X.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in X.score(docs, model).collect()}
    held = {r["doc_id"] for r in docs.filter(X.held_out()).collect()}
    said = [(got[i] >= X.THRESHOLD, y) for i, _, y in rows if i in held]
    assert len(said) > 300
    assert np.mean([p == y for p, y in said]) > 0.97
    assert got[9000] == got[9001] < 0.5
    kept = X.without_toxic(docs.withColumn("score", docs.doc_id), labels)
    assert kept.columns == ["doc_id", "text", "score"]
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if s < X.THRESHOLD}


def test_held_out_labels_do_not_matter(spark):
    rows = texts(2, 400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    held = {r["doc_id"] for r in docs.filter(X.held_out()).collect()}
    one = X.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    two = X.train(docs, spark.createDataFrame([(i, 1 - y if i in held else y) for i, _, y in rows], "doc_id long, toxic int"))
    assert np.array_equal(one.weights, two.weights) and one.bias == two.bias


def test_one_kind_of_label(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(9)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(9)], "doc_id long, toxic int")
    assert X.train(docs, labels).score(["zorgly"])[0] < 1e-6
    assert 0 <= X.train(docs, labels.limit(0)).score([None])[0] < 1e-6


def test_features_are_within_words():
    doc, bucket = X.features(["ab cd", None, "abcdef"])
    assert set(doc) == {0, 2}
    padded = lambda w: sum(max(len(w) + 2 - n + 1, 0) for n in X.GRAMS)
    assert (doc == 0).sum() == 2 * padded("ab") and (doc == 2).sum() == padded("abcdef")
    again = X.features(["x abcdef\ny"])
    assert set(bucket[doc == 2]) <= set(again[1])


def test_against_a_plain_fit(spark):
    """Counts, ratios and the optimum, computed from sets of n-grams without any of the operator's tables."""
    rows = texts(5, 300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    held = {r["doc_id"] for r in docs.filter(X.held_out()).collect()}
    model = X.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    learnt = [(t, y) for i, t, y in rows if i not in held]

    def buckets(text):
        grams = {(" " + w + " ")[k : k + n] for w in text.lower().split() for n in X.GRAMS for k in range(len(w) + 3 - n)}
        found = X.features([text])[1]
        assert len(set(found.tolist())) <= len(grams) <= len(found)  # a bucket a gram, but for collisions
        return set(found.tolist())

    sets, y = [buckets(t) for t, _ in learnt], np.array([v for _, v in learnt], float)
    n, m = (y == 0).sum(), (y == 1).sum()
    r = {}
    for b in set().union(*sets):
        a, t = sum(b in s for s, v in learnt_sets(sets, y) if not v), sum(b in s for s, v in learnt_sets(sets, y) if v)
        seen, total = a + t, n + m
        gain = 2 * sum(x * np.log(x / e) for x, e in ((a, seen * n / total), (t, seen * m / total), (n - a, (total - seen) * n / total), (m - t, (total - seen) * m / total)) if x)
        if seen >= X.LEAST_SEEN and gain >= X.LEAST_GAIN:
            r[b] = np.log((t + 1) / (m + 2)) - np.log((a + 1) / (n + 2))
    assert set(np.flatnonzero(model.weights)) <= set(r)
    at = {b: k for k, b in enumerate(r)}
    matrix = np.zeros((len(y), len(r)))
    for i, s in enumerate(sets):
        for b in s & r.keys():
            matrix[i, at[b]] = r[b]
    ratio = np.array(list(r.values()))
    w, bias = model.weights[list(r)] / ratio, model.bias
    loss = lambda w, bias: (np.logaddexp(0, matrix @ w + bias) - y * (matrix @ w + bias)).mean() + 0.05 * (w**2).sum() / 2 / len(y)
    best_w, best_b = np.zeros_like(w), 0.0
    for _ in range(4000):  # plain gradient descent
        g = 1 / (1 + np.exp(-(matrix @ best_w + best_b))) - y
        best_w, best_b = best_w - 0.05 * (matrix.T @ g / len(y) + 0.05 * best_w / len(y)), best_b - 0.05 * g.mean()
    assert loss(w, bias) <= loss(best_w, best_b) + 0.01


def learnt_sets(sets, y):
    return zip(sets, y, strict=True)


def test_the_sample_is_bounded_by_rows_and_bytes(spark):
    docs = spark.createDataFrame([(i, "word " * 20) for i in range(100)] * 2 + [(0, "another")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    held = {r["doc_id"] for r in docs.filter(X.held_out()).collect()}
    assert X.training_rows(docs, labels).count() == len(set(range(100)) - held) + (0 not in held)
    assert X.training_rows(docs, labels, most=10).count() == 10
    assert X.training_rows(docs, labels, most_bytes=1000).count() in (10, 11)


def test_labels_of_absent_documents_do_not_use_up_the_sample(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(300)], "doc_id long, text string")
    held = {i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1}
    labels = spark.range(59_300).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    assert X.training_rows(docs, labels).count() == 300 - len(held)
    assert X.training_rows(docs, labels, most=150).count() == 150


def test_no_limit_of_features(spark):
    """More features than 16 bits number, and the same model where the limit does not bind."""
    rows = [(i, " ".join(hashlib.md5(f"{i % 2}/{k}".encode()).hexdigest()[:12] for k in range(6000)), i % 2) for i in range(0, 60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    every, some = X.train(docs, labels, most_features=None), X.train(docs, labels)
    assert (every.weights != 0).sum() > 1 << 16 and (some.weights != 0).sum() == X.MAX_FEATURES
    assert every.score([rows[1][1]])[0] > 0.9 > 0.1 > every.score([rows[0][1]])[0]

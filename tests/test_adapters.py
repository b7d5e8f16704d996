"""Encoders, passwords and tokens, landed files, reports, models that fail."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.operators import auth, bm25, chat, embed, evalset, evaluate, fusion, parser, registry, retrieve, vectors
from corpuscle.sources import files


class Rows:
    """An encoder that gives a vector a token, of which the first counts."""

    def tokenize(self, text):
        return [len(w) for w in text.split()]

    def run(self, ids, mask):
        out = np.zeros((len(ids), max(ids.shape[1], 1), 2))
        out[:, : ids.shape[1], 0] = ids * mask
        out[:, : ids.shape[1], 1] = mask
        return out


def test_encoders(spark):
    assert embed.encode(Rows(), ["abc d", "", "12345678"]).round(6).tolist() == [[0.948683, 0.316228], [0, 0], [0.992278, 0.124035]]
    assert embed.encode(embed.Letters(), ["ab" * 600], limit=3).round(4).tolist()[0][:2] == [0.8944, 0.4472]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["ab", None, "zzz"] * 30)], "i int, t string").repartition(2)
    got = {r["i"]: r["v"] for r in rows.select("i", embed.embedder(batch=7)(F.col("t")).alias("v")).collect()}
    own = embed.EmbeddingFunction("letters")
    assert own.name() == "letters"
    assert [got[i] for i in range(3)] == own(["ab", "", "zzz"]) == own.embed_query(["ab", "", "zzz"])


def test_passwords(spark):
    stored = auth.password_hash("s3cret é", 1000, b"0123456789abcdef")
    key = hashlib.pbkdf2_hmac("sha256", "s3cret é".encode(), b"0123456789abcdef", 1000)
    assert stored == f"pbkdf2_sha256$1000${base64.b64encode(b'0123456789abcdef').decode()}${base64.b64encode(key).decode()}"
    assert auth.password_fits("s3cret é", stored)
    assert not any(auth.password_fits(p, s) for p, s in [("other", stored), (None, stored), ("s3cret é", None), ("s3cret é", "junk"), ("s3cret é", stored.replace("pbkdf2", "x"))])
    rows = spark.createDataFrame([("a", "one"), ("b", "two")], "username string, password string").withColumn("password_hash", auth.hashed(F.col("password"), 10)).cache()
    assert rows.select(auth.fits(F.col("password"), F.col("password_hash")).alias("ok")).distinct().collect() == [(True,)]
    assert rows.select("password_hash").distinct().count() == 2


@pytest.mark.parametrize("secret", ["short", "a very long key " * 9])
def test_tokens(spark, secret):
    made = spark.range(1).select(auth.token(F.lit("ü"), F.lit("user"), F.lit(100), 2, secret).alias("t")).first()["t"]
    head, body, signature = made.split(".")
    plain = lambda x: base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))
    assert json.loads(plain(head)) == {"alg": "HS256", "typ": "JWT"}
    assert json.loads(plain(body)) == {"sub": "ü", "role": "user", "iat": 100, "exp": 220}
    assert plain(signature) == hmac.new(secret.encode(), f"{head}.{body}".encode(), "sha256").digest()
    cases = [(made, 219), (made, 220), (made + "x", 0), (f"{head}.{body}", 0), ("junk", 0), (None, 0), (f"{head}.{body[:-2]}xx.{signature}", 0)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, now long")
    got = rows.select("i", auth.claims(F.col("t"), F.col("now"), secret).alias("c")).orderBy("i").collect()
    assert [r["c"] and r["c"]["sub"] for r in got] == ["ü", None, None, None, None, None, None]


def test_landed_files_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("x/a.txt", b"one"), ("b.exe", b"two"), ("c.docx", b"")], "filename string, content binary")
    queued, bad, written = files.land(rows, f"file://{tmp_path}/raw", F.timestamp_seconds(F.lit(5)))
    assert {(r["filename"], r["bytes"]) for r in written.collect()} == {("a.txt", 3), ("c.docx", 0)}
    assert (tmp_path / "raw" / "a.txt").read_bytes() == b"one"
    assert {(r["filename"], r["status"], r["size"], r["chunk_count"]) for r in queued.collect()} == {("a.txt", "queued", 3, 0), ("c.docx", "queued", 0, 0)}
    assert [r["reason"] for r in bad.collect()] == ["suffix"]
    jobs = spark.createDataFrame([(1, "# R\nü"), (2, None), (3, "")], "id long, report_content string")
    files.write_reports(jobs, f"file://{tmp_path}/reports").count()
    read = files.read_reports(spark, f"file://{tmp_path}/reports")
    assert {tuple(r) for r in registry.with_reports(jobs.select("id"), read).collect()} == {(1, "# R\nü"), (2, None), (3, None)}  # an empty file has no content


def test_reports_as_word_documents(spark):
    raw = spark.createDataFrame([("# Title\nA < B\n\n## Part\nend",)], "t string").select(files.docx(F.col("t")).alias("d")).first()["d"]
    assert files.docx_text(bytes(raw)) == "Title\nA < B\nPart\nend"


def test_a_model_that_fails(spark):
    pool = spark.createDataFrame([(1, "q", "b", 1, 0.9), (1, "q", "q", 2, 0.8), (2, "q", "x", 1, 0.7), (2, "q", "q", 2, 0.6)], "query_id long, query string, text string, rank int, score double")

    def broken():
        raise OSError("no model")

    assert {tuple(r) for r in fusion.rerank(pool, fusion.model_scorer(broken)).select(*pool.columns).collect()} == {tuple(r) for r in pool.collect()}
    once = fusion.rerank(pool, fusion.model_scorer(lambda: lambda q, t: [float(a == b) for a, b in zip(q, t, strict=True)]))
    assert {(r["query_id"], r["text"], r["rank"], r["score"]) for r in once.collect()} == {(1, "q", 1, 1.0), (1, "b", 2, 0.0), (2, "q", 1, 1.0), (2, "x", 2, 0.0)}


def test_generation_by_batches(spark, tmp_path):
    log = str(tmp_path / "calls")

    def model(asked):
        with open(log, "a") as f:
            f.write(f"{len(asked)}\n")
        if any(u == "bad" for _, u in asked):
            raise ValueError("no answer")
        return [f"<think>x</think> to {u}" for _, u in asked]

    jobs = spark.createDataFrame([(i, "s", "bad" if i == 7 else f"u{i}") for i in range(9)], "id long, system string, user string").coalesce(1)
    got = {r["id"]: (r["answer"], r["error"]) for r in chat.generate(jobs, model, batch=5).collect()}
    assert got == {i: (f"to u{i}", None) for i in range(9) if i != 7} | {7: (None, "no answer")}
    assert open(log).read().split() == ["5", "4", "1", "1", "1", "1"]


def test_layers_and_self_test(spark):
    chunks = spark.createDataFrame([("a", 1, "fire doors must be shut", "s1"), ("b", 2, "water", "s2")], "id string, corpus_pos long, text string, source string")
    corpus = retrieve.Corpus(chunks.withColumn("embedding", embed.embedder()(F.col("text"))))
    seen = retrieve.layers(spark.createDataFrame([(1, "fire")], "query_id long, text string"), corpus, top_k=1)
    assert [(r["source"], r["head"]) for r in seen["hits"].collect()] == [("s1", "fire doors must be shut")]
    assert seen["context"].first()["context"].startswith("[1]")
    assert retrieve.self_test(corpus, "fire", embed.embedder()) == ""
    assert retrieve.self_test(retrieve.Corpus(chunks.limit(0)), "fire") == "nothing was found"
    assert retrieve.self_test(retrieve.Corpus(chunks.drop("text")), "fire")


def test_vectors_of_other_lengths_and_nulls(spark):
    corpus = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 2, [1.0, 0.0, 0.0]), (3, 3, None), (4, 4, [0.0, 0.0]), (5, 5, [3.0, 4.0])], "id long, corpus_pos long, embedding array<double>")
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0, 1.0]), (3, None)], "query_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in vectors.vector_rank(asked, corpus, 9).collect()}
    assert got == {(1, 1): (1, 1.0), (1, 2): (5, 0.6), (1, 3): (4, 0.0), (2, 1): (2, 0.0)}


def test_many_queries_in_few_passes(spark, monkeypatch):
    corpus = spark.createDataFrame([(i, i, f"w{i % 7} w{i % 3} x") for i in range(50)], "id long, corpus_pos long, text string").repartition(3)
    queries = spark.createDataFrame([(q, f"w{q % 9} x" if q % 5 else "") for q in range(40)], "query_id long, text string")
    index = bm25.build(corpus)
    want = sorted(map(tuple, bm25.rank(bm25.score(queries, index), index, 4, query_ids=queries).collect()))
    monkeypatch.setattr(bm25, "QUERIES_AT_ONCE", 7)
    for size in (1, 1 << 20):
        monkeypatch.setattr(bm25, "AT_ONCE_BYTES", size)
        got = bm25.rank_batch(queries, corpus, 4).select("query_id", "id", "score", "rank", "corpus_pos")
        assert sorted(map(tuple, got.collect())) == want


def test_texts_that_hold_queries(spark, monkeypatch):
    corpus = spark.createDataFrame([("a", "one two three"), ("b", "two"), ("c", None), ("d", "ne tw")], "source string, text string")
    queries = spark.createDataFrame([(1, "two"), (2, "ne tw"), (3, ""), (4, "two"), (5, "none")], "query_id long, text string")
    for size in (1, 1 << 20):
        monkeypatch.setattr(evaluate, "PATTERN_BYTES", size)
        assert {tuple(r) for r in evaluate.containing(corpus, queries).collect()} == {(1, "a"), (1, "b"), (4, "a"), (4, "b"), (2, "a"), (2, "d")}


@pytest.mark.parametrize("values", [[f"doc{i}.txt" for i in range(700)], ["中华人民共和国" + str(i) for i in range(50)] + ["a", "zz"], ["one"], [3, 1, 2]])
def test_ranks_of_all(spark, monkeypatch, values):
    monkeypatch.setattr(registry, "BOUNDS", 8)
    rows = spark.createDataFrame([(v,) for v in values], ["x"]).repartition(4)
    got = {r["x"]: r["_rank"] for r in registry.global_ranks(rows, "x").collect()}
    assert got == {v: i + 1 for i, v in enumerate(sorted(values))}


def test_headings_in_digits_of_any_script(spark):
    rows = spark.createDataFrame([("１．总则",), ("٣.٢ نص",), ("1、范围",), ("１２．３ 适用",), ("x1. no",), ("1. 完句。",)], "t string")
    got = [r["h"] and tuple(r["h"]) for r in rows.select(parser.heading(parser.T.squeeze(F.col("t")), F.col("t")).alias("h")).collect()]
    assert got == [("１", "总则", 1), ("٣.٢", "نص", 2), ("1", "范围", 1), ("１２", "３适用", 1), None, None]


def test_scenes_of_fields(spark):
    rows = spark.createDataFrame([("f1", "电梯"), ("f2", "unknown")], "filename string, domain string")
    said = {r["domain"]: r["t"] for r in rows.select("domain", evalset.news_text(F.lit("某市"), F.col("domain"), 1).alias("t")).collect()}
    assert all(x in said["电梯"] for x in ("某市",) + evalset.SCENES["电梯"])
    assert evalset.ANY_SCENE[1] in said["unknown"]
    assert set(evalset.SCENES) == set(evalset.DOMAINS)

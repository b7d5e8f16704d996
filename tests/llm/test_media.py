from __future__ import annotations

import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

from corpuscle.llm import media as M

TEXTS = ["a" * 63, "a" * 64, "a" * 65, "", None, "é😀\x00", "long " * 20_000, "a" * 64]


def test_payloads(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in M.op10_interleaved_media(spark, str(tmp_path)).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        size = max(64, -(-len(raw) // 64) * 64)
        payload = raw + bytes(size - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), size)
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        form = M.encode_pgm(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(form), hashlib.sha256(form).hexdigest())
        assert M.decode_pgm(form) == payload
        assert r["position"] == 3 and r["caption"] == f"document {i} as samples"
        samples = list(payload)
        mean = sum(samples) / size
        shares = [samples.count(v) / size for v in set(samples)]
        said = dict(x.split("=") for x in r["feature"].split(";"))
        assert float(said["mean"]) == pytest.approx(mean, abs=1e-4)
        assert float(said["std"]) == pytest.approx((sum((v - mean) ** 2 for v in samples) / size) ** 0.5, abs=1e-4)
        assert abs(float(said["entropy"])) == pytest.approx(-sum(p * math.log2(p) for p in shares), abs=1e-4)
        bands = [1000 * sum(32 * k <= v < 32 * k + 32 for v in samples) / size for k in range(8)]
        assert [int(x) for x in said["bands"].split(",")] == pytest.approx(bands, abs=0.51)
    assert got[1]["feature"] == got[7]["feature"] != got[0]["feature"]


def test_a_page_keeps_order_and_captions(spark):
    html = spark.range(1).select(M.page_of(F.lit("x"), F.lit(7)).alias("html")).first()["html"]
    own, none = hashlib.sha256(b"x").hexdigest(), hashlib.sha256(b"").hexdigest()
    got = [(x["kind"], x["text"] or x["digest"], x["caption"]) for x in M.parse_sequence(html)]
    assert got == [("text", "document 7", None), ("media", none, "cover"), ("text", "its text", None), ("media", own, "document 7 as samples"), ("text", "end", None)]


def test_sequences():
    html = """<h1>T &amp; x</h1><p>one <b>two</b></p><figure><img src="sha256:abc" alt="alt"><figcaption>Cap <i>tion</i></figcaption></figure>
    text<img src='d&amp;e'>tail<!-- <img src=no> --><script>"<img src=no>"</script><figure><video src=v1></video><img src=v2><figcaption>both"""
    got = [(x["position"], x["kind"], x["text"] or x["digest"], x["caption"]) for x in M.parse_sequence(html)]
    assert got == [
        (0, "text", "T & x", None),
        (1, "text", "one two", None),
        (2, "media", "abc", "Cap tion"),
        (3, "text", "text", None),
        (4, "media", "d&e", None),
        (5, "text", "tail", None),
        (6, "media", "v1", "both"),
        (7, "media", "v2", "both"),
    ]
    assert M.parse_sequence(None) == [] == M.parse_sequence("")


def test_unknown_reference_keeps_its_place(spark):
    docs = spark.createDataFrame([("known",)], "text string")
    features = M.media_features(M.store_media(docs))
    digest = hashlib.sha256(b"known").hexdigest()
    pages = spark.createDataFrame([(1, f"<p>a</p><img src='sha256:{digest}' alt='x'><img src='sha256:none' alt='y'>")], "page_id long, html string")
    got = M.resolve(M.sequences(pages), features).orderBy("position").collect()
    assert [(r["position"], r["caption"], r["n_bytes"]) for r in got] == [(1, "x", 5), (2, "y", None)]


def test_broken_media():
    with pytest.raises(ValueError):
        M.decode_pgm(b"P5\n64 2\n255\nshort")
    with pytest.raises(ValueError):
        M.decode_pgm(b"GIF")

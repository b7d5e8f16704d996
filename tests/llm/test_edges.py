"""Every dealt query and every pipeline stage on empty tables, nulls, empty and long texts, repeated rows, extra columns."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer as Reader

import corpus_pipeline
from corpuscle.llm.packing import default_tokenizer
from corpuscle.llm.registry import QUERIES
from tests.llm.test_substring import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tid long, score double, position long, slot int, `Text id` string, _g string, _row int, stretch int, repeats string, queue_position long"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
ROWS = [
    (0, None, "en", "a", None, 1, 0.5, 7, 1, "x"),
    (50, "", "en", "a", 0, None, None, None, None, None),
    (1, "   \n\t", None, None, None, 1, 0.5, 7, 1, "x"),
    (2, "one", "en", "b", 3, 1, 0.5, 7, 1, "x"),
    (None, "one two three four five six seven", "en", "b", 33, 1, 0.5, 7, 1, "x"),
    (3, "you idiot of a moron", "en", "a", 20, 1, 0.5, 7, 1, "x"),
    (3, "you idiot of a moron", "en", "a", 20, 1, 0.5, 7, 1, "x"),
    (4, LONG, "en", "a", len(LONG), 1, 0.5, 7, 1, "x"),
    (5, LONG + " tail", "en", None, len(LONG) + 5, 1, 0.5, 7, 1, "x"),
    (6, "ünïcödé 日本語 😀 <|endoftext|> \x1c a\x00b", "de", "c", 30, 1, 0.5, 7, 1, "x"),
    (7, "you idiot of a moron", "en", "c", 20, 1, 0.5, 7, 1, "x"),
]
EMBEDDINGS = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (100, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (150, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (5, []), (6, [-0.0, 1.0])]
PAGES = [(0, "http://a.example/1", "<p>x</p>"), (1, None, None), (2, "http://a.example/2", ""), (None, "x", "<p>x</p>"), (3, "http://b.example", "<div <p>&amp;&nbsp;<b>"), (3, "http://b.example", "<div <p>&amp;&nbsp;<b>"), (4, "http://b.example\r\nX: 1", "<p>" + LONG)]
LABELS = [(0, 1, 0), (3, 0, 1), (2, 1, None), (None, 1, 1), (4, 1, 0), (4, 1, 1), (99, 1, 1)]


EXTRA = ("g", 5, 6, "r", 7)


def tables(spark, path, some):
    cut = slice(None) if some else slice(0)
    for name, rows, schema in (
        ("documents", [(*r, *EXTRA) for r in ROWS], DOCS),
        ("embeddings", [(*r, 1, 2) for r in EMBEDDINGS], "vec_id long, embedding array<float>, label int, vid int"),
        ("pages", [(*r, "h") for r in PAGES], "page_id long, url string, html string, host string"),
        ("benchmark", [(1, "one two three four"), (None, None), (2, "")], "item_id long, text string"),
        ("labels", LABELS, "doc_id long, quality int, toxic int"),
    ):
        spark.createDataFrame(rows[cut], schema).coalesce(2).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def edge_dir(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("edge"), True)


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("empty"), False)


@pytest.mark.parametrize("name", QUERIES)
def test_edge_rows(spark, edge_dir, name):
    out = QUERIES[name](spark, edge_dir).collect()
    rows = {"embeddings": None, "pages": len(PAGES), "documents": len(ROWS)}
    table = {"op1": "embeddings", "op12": "embeddings", "op3": "pages", "op4": "pages"}.get(name.split("_")[0], "documents")
    if rows[table] and not name.startswith("op8_"):
        assert len(out) == rows[table]


def rows_of(spark, path, name):
    return QUERIES[name](spark, path).collect()


def test_values_of_substring_dedup(spark, edge_dir):
    want, _ = brute([r[1] for r in ROWS], 35)
    got = Counter(tuple(r)[:4] for r in rows_of(spark, edge_dir, "op2_fixed_block_anchors"))
    assert got == Counter((r[0], *w) for r, w in zip(ROWS, want, strict=True))


def test_values_of_near_dedup(spark, edge_dir):
    got = Counter((r["doc_id"], r["class_id"]) for r in rows_of(spark, edge_dir, "op7_dart_minhash"))
    same = {7: 3, 5: 4}  # exact copies, and 30,000 words with one more
    assert got == Counter((r[0], same.get(r[0], r[0])) for r in ROWS)


def test_values_of_shards_and_media(spark, edge_dir):
    raw = [(r[0], (r[1] or "").encode("utf-8", "surrogatepass")) for r in ROWS]
    got = rows_of(spark, edge_dir, "op5_fixed_slots")
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len(t) + 1, zlib.crc32(t)) for i, t in raw)
    for shard in {r["shard"] for r in got}:
        places = [r["slot"] for r in got if r["shard"] == shard]
        assert 0 <= shard < 8 and sorted(places) == list(range(len(places)))
    got = rows_of(spark, edge_dir, "op10_interleaved_media")
    full = [(i, len(t), t + bytes(max(64, -(-len(t) // 64) * 64) - len(t))) for i, t in raw]
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == Counter((i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for i, n, p in full)


def test_values_of_packing(spark, edge_dir):
    """Each document's pieces, put together, are its ids and the end; sequences are filled without gaps."""
    own = Reader.from_file(default_tokenizer())
    pieces = rows_of(spark, edge_dir, "op8_deficit_packing")
    ids = [np.array([*own.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4") for r in ROWS]
    want = Counter((r[0], len(x)) for r, x in zip(ROWS, ids, strict=True))
    assert Counter({k: n for k, n in Counter((p["doc_id"], p["doc_tokens"]) for p in pieces if p["start"] == 0).items()}) == want
    of = {(r[0], len(x)): x for r, x in zip(ROWS, ids, strict=True)}
    for p in pieces:
        assert p["ids_crc32"] == zlib.crc32(of[p["doc_id"], p["doc_tokens"]][p["start"] : p["start"] + p["length"]].tobytes())
    assert sum(p["length"] for p in pieces) == sum(map(len, ids))
    at = sorted((p["sequence_id"], p["offset"], p["length"]) for p in pieces)
    for (s, o, n), (s2, o2, _) in zip(at, at[1:], strict=False):
        assert (s2, o2) == ((s, o + n) if s2 == s else (s + 1, 0)) and (s2 == s or o + n == 4096)


def test_values_of_mixing_toxicity_and_pages(spark, edge_dir):
    mixed = rows_of(spark, edge_dir, "op9_pfair_mix")
    assert sorted(r["position"] for r in mixed) == list(range(len(ROWS)))
    assert Counter((r["doc_id"], r["source"]) for r in mixed) == Counter((r[0], r[3]) for r in ROWS)
    scores = rows_of(spark, edge_dir, "op6_nbsvm_toxicity")
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in scores)
    assert len({r["score"] for r in scores if r["doc_id"] in (3, 7)}) == 1
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in scores)
    texts = Counter((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in rows_of(spark, edge_dir, "op3_template_deduction"))
    said = {0: "x", 1: "", 2: "", None: "x", 3: "<div\n\n&", 4: LONG}  # a tag that does not end is text
    assert texts == Counter((p[0], p[1], said[p[0]], len(said[p[0]])) for p in PAGES)
    records = rows_of(spark, edge_dir, "op4_warc_ranges")
    assert Counter((r["page_id"], r["payload_bytes"]) for r in records) == Counter((p[0], len((p[2] or "").encode())) for p in PAGES)
    assert {(r["page_id"], r["refers_to"]) for r in records if r["record_type"] == "revisit"} == {(None, 0), (2, 1)}


def test_values_of_neighbours(spark, edge_dir):
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in rows_of(spark, edge_dir, "op1_multiprobe_lsh")]
    half = round(0.5**0.5, 6)
    assert sorted(got) == [(0, 1, 50, 1.0), (0, 2, 1, half), (0, 3, 6, 0.0), (50, 1, 0, 1.0), (50, 2, 1, half), (50, 3, 6, 0.0)]


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, empty_dir, name):
    out = QUERIES[name](spark, empty_dir)
    assert out.columns
    assert out.count() == 0


@pytest.mark.parametrize("which", ["edge", "empty"])
def test_pipeline_stages(spark, edge_dir, empty_dir, which, tmp_path):
    path = edge_dir if which == "edge" else empty_dir
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    given = Counter(map(tuple, docs.drop("text", "n_chars").collect()))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            carried = [c for c in columns if c not in ("text", "n_chars")]
            assert not Counter(map(tuple, docs.select(*[f"`{c}`" for c in carried]).collect())) - given
    assert (docs.count() > 0) == (which == "edge")

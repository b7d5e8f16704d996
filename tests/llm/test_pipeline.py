"""The pipeline's stages in turn, each held against its own input."""

from __future__ import annotations

import re
from collections import Counter

import pytest

import corpus_pipeline
from corpuscle.llm import mixing as M
from corpuscle.llm.registry import QUERIES


def test_stages(spark, small, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, tables[-1], small).write.parquet(f"{tmp_path}/{name}")
        tables.append(spark.read.parquet(f"{tmp_path}/{name}"))
    raw, clean, unique, cut, mixed, packed = tables
    scores = {r["doc_id"]: r["predicted"] for r in QUERIES["op6_nbsvm_toxicity"](spark, small).collect()}
    assert {r["doc_id"] for r in clean.collect()} == {i for i, p in scores.items() if not p}
    assert clean.count() > 0.8 * raw.count()
    assert unique.select("text").distinct().count() == unique.count() <= clean.select("text").distinct().count()
    assert cut.count() == unique.count() == mixed.count()
    windows = Counter()
    for r in cut.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
        windows.update({tuple(w[i : i + 35]) for i in range(len(w) - 34) if r["n_chars"]})
    before = {r["doc_id"]: r["text"] for r in unique.collect()}
    assert all(r["text"] == before[r["doc_id"]] or len(r["text"]) < len(before[r["doc_id"]]) for r in cut.collect())
    assert Counter(map(tuple, mixed.collect())) == Counter(map(tuple, cut.collect()))
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in mixed.collect()}


@pytest.mark.parametrize(("exponent", "share"), [(None, 0.25), (1.0, 0.1), (0.0, 0.5)])
def test_sequences_have_the_mixture_of_mixing(spark, monkeypatch, tmp_path, exponent, share):
    if exponent is not None:
        monkeypatch.setattr(M, "EXPONENT", exponent)
    docs = spark.createDataFrame([(i, "ab the " * 500, "few" if i % 10 == 0 else "many") for i in range(1000)], "doc_id long, text string, source string")
    corpus_pipeline.mixing(spark, docs, "").write.parquet(f"{tmp_path}/mixed")
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    packed = corpus_pipeline.packing(spark, mixed, "")
    first = [r for r in packed.collect() if r["sequence_id"] < 16]
    assert sum(r["length"] for r in first) == 16 * 4096
    assert abs(sum(r["length"] for r in first if r["doc_id"] % 10 == 0) / (16 * 4096) - share) < 0.01


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0

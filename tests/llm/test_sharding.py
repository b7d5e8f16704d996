from __future__ import annotations

import zlib
from collections import Counter, defaultdict

from corpuscle.llm import sharding as S

ROWS = [(i, "x" * (i * 37 % 900)) for i in range(2000)] + [(1, "x" * 37)] * 300 + [(2001, None), (None, "é")]


def test_places(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(7)
    got = S.shard_documents(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ROWS)
    by = defaultdict(list)
    load = Counter()
    for r in got:
        by[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert sorted(by) == list(range(8))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(load.values()) - min(load.values()) < 0.02 * max(load.values())


def test_maps(spark, tmp_path):
    loads = {k: 100 + k % 7 for k in range(4096)}
    one = S.plan_map(loads)
    S.save_map(spark, one, str(tmp_path / "map"), 1)
    nine = S.edit_map(one, loads, 9)
    S.save_map(spark, nine, str(tmp_path / "map"), 2)
    assert S.load_map(spark, str(tmp_path / "map")) == nine and S.load_map(spark, str(tmp_path / "map"), 1) == one
    moved = {k for k in one if one[k] != nine[k]}
    assert moved and all(nine[k] == 8 for k in moved)  # only into the new shard
    sums = Counter()
    for k, s in nine.items():
        sums[s] += loads[k]
    assert max(sums.values()) < 1.02 * min(sums.values())
    drifted = dict(loads) | {k: 300 for k in one if one[k] == 0}
    fixed = S.edit_map(one, drifted, 8)
    assert all(one[k] == 0 for k in one if one[k] != fixed[k])


def test_placing_by_stored_versions(spark, tmp_path):
    """One more shard: the next version moves a part of the records, and older versions still place as before."""
    path = str(tmp_path / "map")
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    where = lambda df: Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in df.collect())
    one = where(S.shard_documents(docs, map_path=path))
    assert S.rebalance(docs, path, 9) == 2
    nine = where(S.shard_documents(docs, map_path=path, version=2))
    assert where(S.shard_documents(docs, map_path=path, version=1)) == one
    moved = sum((nine - one).values())
    assert 0 < moved < 0.4 * len(ROWS) and {k[3] for k in nine} == set(range(9))
    load = Counter()
    for (_, size, _, shard), n in nine.items():
        load[shard] += size * n
    assert max(load.values()) < 1.2 * sum(load.values()) / 9


def test_many_copies_of_a_record(spark, monkeypatch):
    monkeypatch.setattr(S, "RUN", 7)
    docs = spark.range(100).selectExpr("1L AS doc_id", "'x' AS text")
    assert sorted(r["slot"] for r in S.shard_documents(docs).collect()) == list(range(100))

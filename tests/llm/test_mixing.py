from __future__ import annotations

from collections import Counter

import pytest

from corpuscle.llm import mixing as M


def slots_of(lines):
    return sorted((base + x, q) for q, _, _, _, _, _, _, base, _, _, slots in lines for x in slots)


@pytest.mark.parametrize("share", [{0: 1, 1: 1}, {0: 37, 1: 5, 2: 22}, {0: 900, 1: 100, 2: 20, 3: 4}, {i: i + 1 for i in range(20)}])
def test_pfair(share):
    """Every block between its release and its deadline, and every source less than a block from its target at every slot."""
    total = sum(share.values())
    order = slots_of(x for x in M.schedule(share, share) if x[1] == 0)
    seen = Counter()
    for slot, q in order:
        b = seen[q]
        assert b * total // share[q] <= slot < -(-(b + 1) * total // share[q])
        seen[q] += 1
        for k, a in share.items():
            assert abs(seen[k] - a * (slot + 1) / total) < 1


def rows(sizes):
    return [(i, f"text {s} {i}", s, len(str(i)), i, "x") for s, n in sizes.items() for i in range(n)]


SCHEMA = "doc_id long, text string, source string, n_chars long, position long, slot string"


@pytest.mark.parametrize("block", [1, 7])
def test_order(spark, block):
    sizes = {"a": 900, "b": 120, None: 60, "c": 7}
    docs = spark.createDataFrame(rows(sizes), SCHEMA).repartition(6)
    target = {"a": 0.5, "b": 0.3, None: 0.15, "c": 0.05}
    got = M.mix_sources(docs, target, block=block).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(sum(sizes.values())))
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter((r[0], r[2]) for r in rows(sizes))
    seen = Counter()
    first = [r for r in got if r["stretch"] == 0]
    assert len(first) >= 64
    for i, r in enumerate(first):
        assert r["release"] <= r["position"] // block < r["deadline"]
        seen[r["source"]] += 1
        for s, w in target.items():
            assert abs(seen[s] - w * (i + 1)) < (1 if block == 1 else 2 * block)
    for s, n in sizes.items():  # queues keep their own order
        assert [r["queue_position"] for r in got if r["source"] == s] == list(range(n))


def test_columns_with_the_names_of_results_keep_their_values(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "ab"[i % 2], 100 + i, f"q{i}", 7, -i, 3.5) for i in range(6)], "doc_id long, text string, source string, position long, queue_position string, stretch int, release long, deadline double")
    out = M.mixed(docs)
    assert out.columns == docs.columns
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, docs.collect()))


@pytest.mark.parametrize(("weights", "n"), [([1.0] * 20, 60_000), ([0.6, 0.3, 0.0999, 0.0001], 60_000), ([n**0.5 for n in range(1, 41)], 60_000), ([1 / 3, 2 / 3], 2_000_000)])
def test_exact_targets_over_long_stretches(weights, n):
    total = sum(weights)
    lines = [x for x in M.schedule({q: n for q in range(len(weights))}, dict(enumerate(weights))) if x[1] == 0]
    order = slots_of(lines)
    assert [s for s, _ in order] == list(range(len(order))) and len(order) >= n
    seen = Counter()
    for slot, q in order:
        seen[q] += 1
        assert -1 < seen[q] - weights[q] / total * (slot + 1) < 1
        if slot % 501 == 0:
            assert all(abs(seen[k] - w / total * (slot + 1)) < 1 for k, w in enumerate(weights))
    assert all(abs(seen[k] - w / total * len(order)) < 1 for k, w in enumerate(weights))


def test_rows_follow_exact_targets(spark):
    docs = spark.createDataFrame(rows({f"s{i}": 600 for i in range(20)} | {"t": 70_000}), SCHEMA).repartition(6)
    got = M.mix_sources(docs, {f"s{i}": 1.0 for i in range(20)} | {"t": 1.0}).orderBy("position").select("position", "source", "release", "deadline", "stretch", "queue_position").collect()
    assert [r["position"] for r in got] == list(range(82_000))
    seen = Counter()
    for r in got:
        assert r["release"] <= r["position"] < r["deadline"]
        assert r["queue_position"] == seen[r["source"]]
        seen[r["source"]] += 1
        if r["stretch"] == 0:
            assert abs(seen[r["source"]] - (r["position"] + 1) / 21) < 1
    assert sum(r["stretch"] == 0 for r in got) > 12_000


def test_many_sources_and_repeats(spark):
    docs = spark.createDataFrame(rows({f"s{i}": 3 for i in range(20)} | {"big": 200}), SCHEMA)
    docs = docs.union(docs)
    got = M.mix_sources(docs, buckets=3).collect()
    assert sorted(r["position"] for r in got) == list(range(520))
    assert M.mixed(docs).columns == docs.columns


def test_every_source_is_a_queue_with_its_own_weight(spark):
    sizes = {f"s{i:02}": 6 for i in range(79)} | {"z": 5, None: 5}
    docs = spark.createDataFrame(rows(sizes), SCHEMA)
    got = M.mix_sources(docs, {s: 1.0 for s in sizes} | {"z": 80.0}).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(sum(sizes.values())))
    assert abs(sum(r["source"] == "z" for r in got[:8]) - 4) <= 1
    for s, n in sizes.items():
        assert [r["queue_position"] for r in got if r["source"] == s] == list(range(n))
    first = [r["source"] for r in M.mix_sources(docs).orderBy("position").limit(81).collect()]
    assert set(first) == set(sizes)


def test_mixed_rows_are_in_order(spark, tmp_path):
    docs = spark.createDataFrame(rows({"a": 300, "b": 300}), SCHEMA).repartition(4)
    M.mixed(docs).write.parquet(str(tmp_path / "out"))
    got = [r["source"] for r in spark.read.parquet(str(tmp_path / "out")).coalesce(1).collect()]
    assert len(got) == 600
    assert all(abs(Counter(got[:n])["a"] - n / 2) <= 2 for n in range(600))


def test_main_path_is_native(spark):
    plan = M.mix_sources(spark.createDataFrame(rows({"a": 5}), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))

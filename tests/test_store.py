"""Versioned stores and keyed tables."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from corpuscle.sources.keyed import KeyedTable
from corpuscle.sources.store import Conflict, Store


def test_versions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.read() == {"version": 0} and store.versions() == []
    assert store.publish({"parts": ["a"]}, 0) == 1 and store.publish({"parts": ["b"]}, 1) == 2
    with pytest.raises(Conflict):
        store.publish({"parts": ["c"]}, 1)
    assert store.read() == {"version": 2, "parts": ["b"]} and store.read(1)["parts"] == ["a"]
    assert [n for n in os.listdir(tmp_path / "s" / "_versions") if n.startswith(".0") and not n.endswith(".crc")] == []
    with pytest.raises(ValueError, match="no version 7"):
        store.read(7)


def frame(spark, rows):
    return spark.createDataFrame([(k, v, "x") for k, v in rows], "name string, n long, note string")


def content(table, version=None):
    return {(r["name"], r["n"]) for r in table.read(version).collect()}


def parts(table, version=None):
    return table.store.read(version)["parts"]


def test_upserts_and_deletes_against_a_dict(spark, tmp_path):
    table, want, rnd = KeyedTable(spark, f"file://{tmp_path}/t", "name", 8), {}, random.Random(1)
    for step in range(6):
        keys = rnd.sample(range(60), 9)
        if step % 3 == 2:
            table.delete(spark.createDataFrame([(f"k{k}",) for k in keys], "name string"))
            for k in keys:
                want.pop(f"k{k}", None)
        else:
            new = {f"k{k}": step * 100 + k for k in keys} | {None: step}
            table.upsert(frame(spark, new.items()))
            want |= new
        assert content(table) == set(want.items())
    assert len(content(table, 1)) == 10  # versions stay readable


def test_only_touched_buckets_are_written(spark, tmp_path):
    """An upsert of 1 % of the keys, and of one."""
    table = KeyedTable(spark, f"file://{tmp_path}/t", "name", 64)
    table.upsert(frame(spark, [(f"k{i}", i) for i in range(2000)]))
    before = parts(table)
    assert len(before) == 64
    changed = [(f"k{i}", -i) for i in range(1, 21)]
    table.upsert(frame(spark, changed))
    after = parts(table)
    own = {str(r[0]) for r in frame(spark, changed).select(F.pmod(F.xxhash64("name"), F.lit(64))).distinct().collect()}
    assert {b for b in after if after[b] != before[b]} == own and len(own) <= 20
    table.upsert(frame(spark, [("k3", 0)]))
    assert sum(after[b] != x for b, x in parts(table).items()) == 1
    # what a reader reads are those files
    files = {f for f in table.read().inputFiles()}
    assert all(any(p in f for p in parts(table).values()) for f in files)


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", "name", 4)
    table.upsert(frame(spark, [("a", 1), ("b", 2)]))
    broken = frame(spark, [("a", 5), ("c", 6)]).withColumn("n", F.when(F.col("name") == "c", F.raise_error("broken").cast("long")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="broken"):
        table.upsert(broken)
    assert content(table) == {("a", 1), ("b", 2)} and table.store.versions() == [1]
    published = table.store.publish
    table.store.publish = lambda *_: (_ for _ in ()).throw(OSError("disk"))
    with pytest.raises(OSError, match="disk"):
        table.upsert(frame(spark, [("a", 9)]))
    table.store.publish = published
    assert content(table) == {("a", 1), ("b", 2)}
    assert table.upsert(frame(spark, [("a", 9)])) == 2 and content(table) == {("a", 9), ("b", 2)}


def test_a_writer_that_is_overtaken_begins_again(spark, tmp_path):
    one, two = (KeyedTable(spark, f"file://{tmp_path}/t", "name", 4) for _ in range(2))
    one.upsert(frame(spark, [("a", 1)]))
    read, raced = one._state, []

    def late(version=None):
        m = read(version)
        if not raced:
            raced.append(two.upsert(frame(spark, [("b", 2)])))
        return m

    one._state = late
    assert one.upsert(frame(spark, [("a", 3)])) == 3
    assert content(two) == {("a", 3), ("b", 2)}


def test_equal_keys_and_new_columns(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", "name", 4)
    with pytest.raises(ValueError, match="equal keys"):
        table.upsert(frame(spark, [("a", 1), ("a", 2)]))
    table.upsert(frame(spark, [("a", 1), ("a", 2), ("b", 0)]), order="n")
    assert content(table) == {("a", 2), ("b", 0)}
    table.upsert(frame(spark, [("c", 3)]).withColumn("size", F.lit(7)))
    assert {(r["name"], r["size"]) for r in table.read().collect()} == {("a", None), ("b", None), ("c", 7)}
    with pytest.raises(ValueError, match="in 4 buckets"):
        KeyedTable(spark, f"file://{tmp_path}/t", "name", 8).read()


def test_empty_changes_and_vacuum(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", "name", 4)
    with pytest.raises(ValueError, match="no version"):
        table.read()
    table.upsert(frame(spark, []))
    assert content(table) == set()
    for i in range(3):
        table.upsert(frame(spark, [("a", i)]))
    gone = table.vacuum(keep=2)
    assert len(gone) == 1 and table.store.versions() == [3, 4] and content(table) == {("a", 2)} and content(table, 3) == {("a", 1)}
    table.delete(spark.createDataFrame([("a",)], "name string"))
    assert content(table) == set()

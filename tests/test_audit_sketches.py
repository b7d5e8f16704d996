"""The audit log as a sink, and sketches within their bounds."""

from __future__ import annotations

import bisect
import random

from pyspark.sql import functions as F

from corpuscle.operators import sketches as S
from corpuscle.streaming.audit import AuditLog

SCHEMA = "username string, action string, n long"


def land(spark, path, *numbers):
    spark.createDataFrame([(f"u{i % 3}", "delete_file", i) for i in numbers], SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def test_batches_are_added_once(spark, tmp_path):
    log = AuditLog(spark, f"file://{tmp_path}/log", SCHEMA)
    rows = spark.createDataFrame([("a", "login", 1), ("b", "login", 2)], SCHEMA)
    assert log.read().count() == 0
    assert log.append(rows, "w", 0) and not log.append(rows, "w", 0) and log.append(rows, "other", 0) and log.append(rows, "w", 1)
    assert log.read().count() == 6 and log.read(version=1).count() == 2


def test_writers_at_once(spark, tmp_path):
    one, two = (AuditLog(spark, f"file://{tmp_path}/log", SCHEMA) for _ in range(2))
    rows = spark.createDataFrame([("a", "login", 1)], SCHEMA)
    write, done = one.store.write, []

    def late(*a, **b):
        done.append(two.append(rows, "two", 0))
        return write(*a, **b)

    one.store.write = late
    assert one.append(rows, "one", 0) and done == [True] and one.read().count() == 2


def test_failures_lose_nothing_and_stop_no_caller(spark, tmp_path):
    log = AuditLog(spark, f"file://{tmp_path}/log", SCHEMA)
    land(spark, tmp_path / "landed", 1, 2)
    landed = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/landed")
    assert log.drain(landed, f"{tmp_path}/check")
    land(spark, tmp_path / "landed", 3)
    publish = log.store.publish
    log.store.publish = lambda *_: (_ for _ in ()).throw(OSError("no space"))
    assert not log.drain(landed, f"{tmp_path}/check")
    land(spark, tmp_path / "landed", 4)
    log.store.publish = publish
    assert log.drain(landed, f"{tmp_path}/check") and log.drain(landed, f"{tmp_path}/check")
    assert sorted(r["n"] for r in log.read().collect()) == [1, 2, 3, 4]

    def crash(*a):  # after publishing, before the checkpoint knows
        publish(*a)
        raise OSError("crash")

    land(spark, tmp_path / "landed", 5)
    log.store.publish = crash
    assert not log.drain(landed, f"{tmp_path}/check")
    log.store.publish = publish
    assert log.drain(landed, f"{tmp_path}/check")
    assert sorted(r["n"] for r in log.read().collect()) == [1, 2, 3, 4, 5]


def test_sketches_over_days(spark):
    rnd = random.Random(1)
    rows = [(d, f"u{rnd.randrange(5000)}", rnd.gauss(100, 30)) for d in range(14) for _ in range(2000)] + [(3, None, None), (20, None, float("nan"))]
    days = S.kept(spark.createDataFrame(rows, "day int, user string, ms double"), ["day"], F.col("user"), F.col("ms"))
    ranks = [0.01, 0.5, 0.95]
    week = F.floor(F.col("day") / 7).alias("week")
    got = {r["week"]: r for r in S.told(S.merged(days.select(week, "n", "distinct_sketch", "quantile_sketch"), ["week"]), ranks).collect()}
    for w in (0, 1):
        own = [r for r in rows if r[0] // 7 == w]
        exact = len({u for _, u, _ in own if u})
        assert got[w]["n"] == len(own) and abs(got[w]["values"] - exact) <= S.DISTINCT_ERROR * exact
        numbers = sorted(x for *_, x in own if x is not None)
        for rank, q in zip(ranks, got[w]["quantiles"], strict=True):
            assert abs(bisect.bisect_right(numbers, q) / len(numbers) - rank) <= S.RANK_ERROR
    assert (got[2]["n"], got[2]["values"], got[2]["quantiles"]) == (1, 0, None)
    few = S.told(S.merged(days.filter("day = 99").drop("day").withColumn("k", F.lit(1)), ["k"]), ranks)
    assert few.count() == 0

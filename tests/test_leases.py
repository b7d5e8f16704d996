"""Leases: no job is held twice, and one that is lost is given out again."""

from __future__ import annotations

import time

import pandas as pd
import pytest

from corpuscle.streaming import leases as L


class Map:
    def __init__(self):
        self.d = {}

    def containsKey(self, k):  # noqa: N802
        return k in self.d

    def getValue(self, k):  # noqa: N802
        return self.d[k]

    def updateValue(self, k, v):  # noqa: N802
        self.d[k] = v

    def removeKey(self, k):  # noqa: N802
        del self.d[k]

    def keys(self):
        return iter(self.d)

    def iterator(self):
        return iter(self.d.items())


class Value:
    v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v


class Handle:
    def __init__(self):
        self.timers = []

    def getMapState(self, *_):  # noqa: N802
        return Map()

    def getValueState(self, *_):  # noqa: N802
        return Value()

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


class At:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.now

    getExpiryTimeInMs = getCurrentProcessingTimeInMs


@pytest.fixture
def queue():
    own = L.Leases(lease=100)
    own.init(Handle())

    def send(now, *events):
        frame = pd.DataFrame([(n, *e) for n, e in enumerate(events)], columns=["at", "kind", "job", "consumer"])
        (out,) = own.handleInputRows(("q",), iter([frame]), At(now))
        return [tuple(None if x is pd.NA or x != x else x for x in r) for r in out[["kind", "job", "consumer", "until"]].itertuples(index=False)]

    def expire(now):
        (out,) = own.handleExpiredTimer(("q",), At(now), At(now))
        return [tuple(r) for r in out[["kind", "job", "consumer"]].itertuples(index=False)]

    return send, expire, own


def test_first_in_first_out_and_none_twice(queue):
    send, _, own = queue
    got = send(0, ("add", "a", None), ("add", "b", None), ("add", "a", None), ("ask", None, "x"), ("ask", None, "y"), ("ask", None, "z"))
    assert got == [("granted", "a", "x", 100), ("granted", "b", "y", 100), ("empty", None, "z", None)]
    assert send(50, ("done", "a", "y"), ("done", "a", "x"), ("fail", "b", "y"), ("ask", None, "z")) == [("refused", "a", "y", None), ("done", "a", "x", None), ("failed", "b", "y", None), ("granted", "b", "z", 150)]
    assert own.handle.timers == [100, 100, 150]


def test_lost_consumers(queue):
    send, expire, _ = queue
    send(0, ("add", "a", None), ("add", "b", None), ("add", "c", None), ("ask", None, "x"), ("ask", None, "y"))
    assert send(60, ("renew", "b", "y")) == [("renewed", "b", "y", 160)]
    assert expire(100) == [("lapsed", "a", "x")]
    # the lapsed job comes before the younger c, and its late consumer is refused
    assert send(110, ("done", "a", "x"), ("renew", "a", "x"), ("ask", None, "z"), ("ask", None, "z")) == [("refused", "a", "x", None), ("refused", "a", "x", None), ("granted", "a", "z", 210), ("granted", "c", "z", 210)]
    assert expire(160) == [("lapsed", "b", "y")]
    assert send(170, ("done", "a", "z"), ("add", "a", None), ("ask", None, "w"), ("ask", None, "w")) == [("done", "a", "z", None), ("granted", "b", "w", 270), ("granted", "a", "w", 270)]


def test_lapsed_but_not_yet_expired(queue):
    """A lease that is over holds no longer, even if its timer is late."""
    send, expire, _ = queue
    send(0, ("add", "a", None), ("ask", None, "x"))
    assert send(100, ("done", "a", "x"), ("what", "a", "x")) == [("refused", "a", "x", None), ("refused", "a", "x", None)]
    assert expire(101) == [("lapsed", "a", "x")]


def test_on_a_stream(spark, tmp_path):
    """Two consumers, one of which is lost: its job lapses by a timer and goes to the other, over a restart of the engine."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out, n = tmp_path / "events", tmp_path / "out", [0]
    schema = "queue string, at long, kind string, job string, consumer string"

    def send(*events):
        spark.createDataFrame([("q", n[0] + i, *e) for i, e in enumerate(events)], schema).coalesce(1).write.mode("append").parquet(str(source))
        n[0] += len(events)

    def run():
        stream = L.leased(spark.readStream.schema(schema).parquet(str(source)), lease=2500)
        return stream.writeStream.outputMode("append").format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="300 milliseconds").start()

    def rows(kind):
        return [(r["job"], r["consumer"]) for r in spark.read.schema(L.OUT).parquet(str(out)).filter(f"kind = '{kind}'").collect()]

    def wait(kind, many, most=60):
        end = time.time() + most
        while len(rows(kind)) < many and time.time() < end:
            time.sleep(0.3)
        return sorted(rows(kind))

    send(("add", "a", None), ("add", "b", None), ("ask", None, "x"), ("ask", None, "y"))
    q = run()
    try:
        assert wait("granted", 2) == [("a", "x"), ("b", "y")]
    finally:
        q.stop()
    time.sleep(3)
    q = run()  # both leases are over by now
    try:
        assert wait("lapsed", 2) == [("a", "x"), ("b", "y")]
        send(("done", "a", "x"), ("ask", None, "z"))
        assert wait("refused", 1) == [("a", "x")]
        assert ("a", "z") in wait("granted", 3)
    finally:
        q.stop()

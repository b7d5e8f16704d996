"""Array arithmetic against numpy, and job states on a stream."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.functions import kernels as K
from corpuscle.functions import text as T
from corpuscle.streaming import jobs


@pytest.mark.parametrize(("size", "factor", "least", "most", "want"), [((640, 480), 32, 4096, 1_700_000, (640, 480)), ((10000, 10), 32, 4096, 2_000_000, None), ((32, 32), 32, 65536, 2_000_000, (256, 256)), ((48, 48), 32, 1, 10**9, (64, 64)), ((80, 80), 32, 1, 10**9, (64, 64))])
def test_fitted_size(spark, size, factor, least, most, want):
    got = spark.createDataFrame([size], "h int, w int").select(K.fitted_size(F.col("h"), F.col("w"), factor, least, most).alias("s")).first()["s"]
    assert (tuple(got) if got else None) == want


def test_bounds(spark):
    got = spark.createDataFrame([(1024, 768)], "h int, w int").select(K.fitted_size(F.col("h"), F.col("w"), 32, 4096, 800_000).alias("s")).first()["s"]
    assert got["height"] % 32 == got["width"] % 32 == 0 and got["height"] * got["width"] <= 800_000


def test_grid(spark):
    got = K.grid_tokens(spark.createDataFrame([(1, 2, 4)], "t int, h int, w int"), 2).orderBy("token").collect()
    assert [(r["row"], r["col"]) for r in got] == [(0, 0), (0, 1), (1, 0), (1, 1), (0, 2), (0, 3), (1, 2), (1, 3)]
    rows = K.bilinear(K.grid_tokens(spark.createDataFrame([(1, 4, 6)], "t int, h int, w int"), 2), 48).collect()
    for r in rows:
        at = (np.linspace(0, 47, 4)[r["row"]], np.linspace(0, 47, 6)[r["col"]])
        low = np.floor(at).astype(int)
        assert r["indices"][0] == low[0] * 48 + low[1]
        assert sum(r["weights"]) == pytest.approx(1, abs=1e-5)
        assert r["weights"][3] == pytest.approx((at[0] - low[0]) * (at[1] - low[1]), abs=1e-5)


def test_rope(spark):
    rows = [(1, 0, 2, None, None, None), (1, 1, 2, 1, 2, 4), (1, 2, 2, None, None, None)]
    got = K.rope_positions(spark.createDataFrame(rows, "seq int, segment int, length int, grid_t int, grid_h int, grid_w int"), 2).orderBy("segment", "k").collect()
    assert [(r["t"], r["h"], r["w"]) for r in got] == [(0, 0, 0), (1, 1, 1), (2, 2, 2), (2, 2, 3), (4, 4, 4), (5, 5, 5)]


def test_pads(spark):
    t = spark.createDataFrame([([0, 7, 9, 7, 3], [4, 0]), ([7], [])], "ids array<int>, sizes array<int>")
    got = [r["x"] for r in t.select(K.expand_pads(F.col("ids"), F.col("sizes"), 7).alias("x")).collect()]
    assert got == [[0, 7, 7, 7, 7, 9, 7, 3], None]


def test_patches():
    image = np.zeros((3, 64, 64), np.float32)
    image[0, 0, 0], image[2, 63, 63] = 1, 9
    got = K.patches(image, 16, 2)
    assert got.shape == (16, 768) and got[0, 0] == 1 and got[15, 767] == 9
    assert K.patches(image, 16, 2, 2).shape == (16, 1536)
    assert K.normalised(np.full((3, 2, 2), 255, np.uint8), [0.5] * 3, [0.5] * 3).max() == pytest.approx(1.0)


def test_log_texts(spark):
    row = spark.createDataFrame([("\x1b[1;1H\x1b7a\x1b8 b", " " + "x" * 90, " ")], "a string, b string, c string").select(T.without_ansi(F.col("a")).alias("a"), T.message_summary(F.col("b")).alias("b"), T.message_summary(F.col("c")).alias("c")).first()
    assert row["a"] == "a b" and row["b"] == "text(90): " + "x" * 80 + "…" and row["c"] == "text(0)"


def test_job_states(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(1, 1, "queued"), (1, 2, "processing"), (1, 3, "completed"), (2, 1, "processing"), (2, 2, "queued")]
    spark.createDataFrame(rows, "id long, at int, to string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.table_stream(spark, str(tmp_path / "in"), "id long, at int, to string")
    q = jobs.job_states(stream).writeStream.outputMode("append").format("memory").queryName("moves").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("moves").collect()))
    assert got == [(1, "pending", "queued", True), (1, "processing", "completed", True), (1, "queued", "processing", True), (2, "pending", "processing", False), (2, "pending", "queued", True)]

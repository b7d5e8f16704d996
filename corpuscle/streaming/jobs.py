"""Queues as streams: ingestion, job states, event windows.

A checkpoint takes the place of a claim: each new row is handled once, and after a crash the batch that was under way is
handled again, so sinks are idempotent by batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

FILES = "path string, modificationTime timestamp, length long, content binary"
# fixed values: which state may follow which
MOVES = {"pending": ["queued"], "queued": ["processing"], "processing": ["completed", "failed", "queued"], "failed": ["queued"], "completed": []}


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """New files of a landing folder: (filename, content, size)."""
    rows = spark.readStream.format("binaryFile").schema(FILES).load(path)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content", F.col("length").alias("size"))


def table_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def once(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run all that is there through `handle`, batch by batch, and stop."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(stream: DataFrame, process: Callable[[DataFrame], tuple[DataFrame, DataFrame]], out: str, checkpoint: str) -> StreamingQuery:
    """Files to chunks and status rows; `process` gives both for a batch.  A batch that is repeated replaces its own output."""

    def handle(batch: DataFrame, number: int) -> None:
        chunks, states = process(batch)
        chunks.write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        states.write.mode("overwrite").parquet(f"{out}/states/batch={number}")

    return once(stream, handle, checkpoint)


def run_jobs(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Queued jobs (id, created_at, ...) through `work`, the oldest first within a batch; `work` gives status rows."""

    def handle(batch: DataFrame, number: int) -> None:
        work(batch.orderBy("created_at", "id")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return once(stream, handle, checkpoint)


class _States(StatefulProcessor):
    """The state of each job; moves that MOVES does not allow are reported and change nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:  # noqa: N802
        events = pd.concat(list(rows)).sort_values(["at", "to"], kind="stable")
        now = self.state.get()[0] if self.state.exists() else "pending"
        out = []
        for to in events["to"]:
            ok = to in MOVES.get(now, [])
            out.append((key[0], now, to, ok))
            now = to if ok else now
        self.state.update((now,))
        yield pd.DataFrame(out, columns=["id", "before", "to", "accepted"])

    def close(self) -> None:
        pass


def job_states(events: DataFrame) -> DataFrame:
    """(id, before, to, accepted) of a stream of moves (id, at, to); needs the RocksDB state store."""
    return events.groupBy("id").transformWithStateInPandas(_States(), f"id {dict(events.dtypes)['id']}, before string, to string, accepted boolean", "append", "none")


def recover(jobs: DataFrame) -> DataFrame:
    """What was being processed when the engine stopped is queued again."""
    return jobs.withColumn("status", F.when(F.col("status") == "processing", "queued").otherwise(F.col("status")))


def retry(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Failed jobs of ids are queued again; others stay."""
    marked = jobs.join(ids.select("id").withColumn("_again", F.lit(True)), "id", "left")
    return marked.withColumn("status", F.when(F.col("_again") & (F.col("status") == "failed"), "queued").otherwise(F.col("status"))).drop("_again").select(*jobs.columns)


def claim(jobs: DataFrame, order: str = "created_at") -> DataFrame:
    """The next job: the oldest that is queued."""
    return jobs.filter(F.col("status") == "queued").orderBy(order, "id").limit(1)


def claim_next(jobs: DataFrame, order: str = "created_at") -> tuple[DataFrame, DataFrame]:
    """(the claimed job, the next state of all jobs with that one in processing): both are written before the job is run.

    One writer takes claims, so no two get one job; on a stream the checkpoint does this.
    """
    one = claim(jobs, order).select("id").withColumn("_claimed", F.lit(True))
    marked = jobs.join(F.broadcast(one), "id", "left")  # one row
    status = F.when(F.col("_claimed"), "processing").otherwise(F.col("status"))
    after = marked.withColumn("status", status)
    return after.filter("_claimed").select(*jobs.columns), after.select(*jobs.columns)


def events_time(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def event_windows(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) for tumbling or sliding windows; batch and stream alike."""
    rows = events_time(events)
    rows = rows.withWatermark("ts", late) if late else rows
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return rows.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user_id, start, finish, n): finish is the last event's time plus the gap."""
    rows = events_time(events)
    rows = rows.withWatermark("ts", late) if late else rows
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("finish"), "n")


def dedupe(events: DataFrame, keys: list[str], late: str | None = None) -> DataFrame:
    """One row a key; on a stream within the watermark."""
    if late:
        return events_time(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)

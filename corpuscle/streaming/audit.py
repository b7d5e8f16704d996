"""The audit log as an exactly-once sink.

Callers land rows in a folder and go on; a stream writes them to a versioned store, each batch as a part that is published
with its number.  A batch that comes again after a crash finds its number and adds nothing; one that fails leaves no trace and is
taken again, from the landed rows, when the stream runs the next time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuscle.sources.store import Conflict, Store
from corpuscle.streaming.jobs import once


class AuditLog:
    """A log in a folder; rows have the columns of `schema` (DDL)."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.store, self.schema = Store(spark, path), schema

    def append(self, rows: DataFrame, writer: str, batch: int, tries: int = 3) -> bool:
        """Add a batch of a writer, whose batches have rising numbers; False if it is there already."""
        m = {"parts": [], "batches": {}} | self.store.read()
        if batch <= m["batches"].get(writer, -1):
            return False
        part = self.store.write(rows, "rows")
        for left in reversed(range(tries)):
            m = {"parts": [], "batches": {}} | self.store.read()
            if batch <= m["batches"].get(writer, -1):
                return False
            try:
                self.store.publish({"parts": [*m["parts"], part], "batches": m["batches"] | {writer: batch}}, m["version"])
                return True
            except Conflict:
                if not left:
                    raise
        return False

    def read(self, version: int | None = None) -> DataFrame:
        return self.store.load(self.store.read(version).get("parts", []), self.schema)

    def drain(self, landed: DataFrame, checkpoint: str, writer: str = "stream") -> bool:
        """Take all landed rows (a stream) that are not in the log yet; False, and nothing lost, if that fails."""
        try:
            once(landed, lambda batch, number: self.append(batch, writer, number), checkpoint).awaitTermination()
        except Exception:  # noqa: BLE001  the rows stay where they landed
            return False
        return True

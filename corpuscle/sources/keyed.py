"""Keyed tables that rewrite only what changes: buckets of the key, each a part of its own in every version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from corpuscle.sources.store import Conflict, Store

BUCKETS = 64
BUCKET = "_bucket"


class KeyedTable:
    """A table with one row for each key, in `buckets` buckets of the key's hash.

    An upsert or delete reads and rewrites the buckets of its keys alone, and publishes a version in which all others are the
    parts that they were.  Null keys are a key; of rows with equal keys in one upsert the last in the order of `order` stays
    (without it they are refused).  A column that a version lacks is null in its rows.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS) -> None:
        self.store, self.key, self.buckets = Store(spark, path), key, buckets

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    def _state(self, version: int | None = None) -> dict:
        m = self.store.read(version)
        if m["version"] and (m["key"], m["buckets"]) != (self.key, self.buckets):
            raise ValueError(f"this table has the key {m['key']} in {m['buckets']} buckets")
        return m

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        m = self._state(version)
        if not m["version"]:
            raise ValueError("this table has no version yet")
        return self._rows(m, m["parts"])

    def _rows(self, m: dict, buckets) -> DataFrame:
        return self.store.load([m["parts"][b] for b in buckets], StructType.fromJson(m["schema"]))

    def upsert(self, rows: DataFrame, order: str | None = None, tries: int = 3) -> int:
        """Insert rows, or replace those of equal keys; the new version."""
        if order:
            latest = F.max_by(F.struct(*rows.columns), F.col(order))
            rows = rows.groupBy(F.col(self.key).alias("_key")).agg(latest.alias("_row")).select("_row.*")
        elif rows.groupBy(self.key).count().filter("count > 1").limit(1).count():
            raise ValueError("rows of equal keys: name the column that orders them")
        return self._change(rows, True, tries)

    def delete(self, keys: DataFrame, tries: int = 3) -> int:
        """Delete the rows with the keys in the column of the key's name; the new version."""
        return self._change(keys.select(self.key).distinct(), False, tries)

    def _change(self, rows: DataFrame, put: bool, tries: int) -> int:
        staged = self.store.write(rows.withColumn(BUCKET, self._bucket()), "_staged")
        staged_schema = StructType([*rows.schema.fields, StructField(BUCKET, IntegerType())])
        given = lambda: self.store.load([staged], staged_schema)
        touched = sorted(r[0] for r in given().select(BUCKET).distinct().collect())  # at most the number of buckets
        try:
            for left in reversed(range(tries)):
                m = self._state()
                try:
                    return self.store.publish(self._changed(m, given(), touched, rows.schema, put), m["version"])
                except Conflict:
                    if not left:
                        raise
        finally:
            self.store._fs.delete(self.store._fs_path(f"{self.store.path}/{staged}"), True)

    def _changed(self, m: dict, given: DataFrame, touched: list[int], schema, put: bool) -> dict:
        parts = dict(m.get("parts", {}))
        known = StructType.fromJson(m["schema"]) if m["version"] else schema
        before = self._rows(m, [str(b) for b in touched if str(b) in parts]) if m["version"] else self.spark.createDataFrame([], schema)
        same = before[self.key].eqNullSafe(given[self.key])
        after = before.join(given.select(self.key), same, "left_anti")
        if put:
            after = after.unionByName(given.drop(BUCKET), allowMissingColumns=True)
            known = after.schema
        # a bucket is one folder of the part, so its name is all that the manifest needs
        part = self.store.write(after.repartition(min(len(touched), self.buckets) or 1, self._bucket()).withColumn(BUCKET, self._bucket()), "data", [BUCKET])
        for b in touched:
            folder = f"{part}/{BUCKET}={b}"
            if self.store._fs.exists(self.store._fs_path(f"{self.store.path}/{folder}")):
                parts[str(b)] = folder
            else:
                parts.pop(str(b), None)
        return {"key": self.key, "buckets": self.buckets, "schema": known.jsonValue(), "parts": parts}

    def vacuum(self, keep: int = 2) -> list[str]:
        return self.store.vacuum(keep, lambda m: m.get("parts", {}).values())

"""Sharding through fixed virtual slots.

Records are hashed into a fixed, large number of virtual slots.  Bytes are aggregated for each slot, and a small
versioned table maps slots to shards; only that table is edited when shards are added or loads drift, so a record never
changes its slot.  The table has `slots` rows whatever the corpus holds, so it may be planned on the driver and broadcast.

Defined results: a null text has size 1 and the CRC of the empty text; a null doc_id is hashed like a value; repeated
rows share a virtual slot and get places of their own, in no order among themselves; very long texts count whole; slots of
equal bytes are dealt in the order of their numbers; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.llm.common import CRC_TABLE_SQL, crc_sql, materialize, new_path

SLOTS = 4096
SHARDS = 8
RUN = 1 << 16  # copies of a record listed at once


def record_digests(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, copies): equal records are counted before anything is shuffled."""
    text = F.coalesce(F.col("text"), F.lit(""))
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    name = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32")
    keyed = one.withColumn("virtual_slot", F.pmod(F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int"))
    return keyed.groupBy("doc_id", "size", "text_crc32", "virtual_slot").agg(F.count(F.lit(1)).alias("copies"))


def slot_loads(digests: DataFrame) -> DataFrame:
    """(virtual_slot, rows, bytes): at most as many rows as there are virtual slots."""
    return digests.groupBy("virtual_slot").agg(F.sum("copies").alias("rows"), F.sum(F.col("copies") * F.col("size")).alias("bytes"))


def plan_map(bytes_of: dict[int, int], slots: int = SLOTS, shards: int = SHARDS) -> dict[int, int]:
    """Version 1 of a map: slots in falling order of bytes, each to the shard with the fewest bytes so far."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot in sorted(range(slots), key=lambda k: (-bytes_of.get(k, 0), k)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + bytes_of.get(slot, 0), shard))
    return out


def edit_map(current: dict[int, int], bytes_of: dict[int, int], shards: int) -> dict[int, int]:
    """The next version for `shards` shards: slots leave only shards above their fair share, for those below it."""
    out, load = dict(current), [0] * shards
    for slot, shard in current.items():
        load[shard] += bytes_of.get(slot, 0)
    fair = sum(load) / shards
    for slot in sorted(current, key=lambda k: (-bytes_of.get(k, 0), k)):
        size, source = bytes_of.get(slot, 0), out[slot]
        target = min(range(shards), key=lambda s: (load[s], s))
        if size and load[source] - size >= fair - size / 2 and load[target] + size <= fair + size / 2 and load[source] > load[target] + size:
            out[slot] = target
            load[source] -= size
            load[target] += size
    return out


def save_map(spark: SparkSession, slot_map: dict[int, int], path: str, version: int) -> None:
    """Append a version to a stored map."""
    rows = [(version, slot, shard) for slot, shard in sorted(slot_map.items())]
    spark.createDataFrame(rows, "version int, virtual_slot int, shard int").coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> dict[int, int]:
    """A stored version, the newest by default; its rows are bounded by the number of virtual slots."""
    table = spark.read.parquet(path)
    version = table.agg(F.max("version")).first()[0] if version is None else version
    return {r["virtual_slot"]: r["shard"] for r in table.filter(F.col("version") == version).collect()}


def place(digests: DataFrame, loads: dict[int, tuple[int, int]], slot_map: dict[int, int]) -> DataFrame:
    """One row for each record with its shard and its gapless place there (`slot`)."""
    spark = digests.sparkSession
    seen: dict[int, int] = {}
    rows = []
    for slot, shard in sorted(slot_map.items()):
        rows.append((slot, shard, seen.get(shard, 0)))
        seen[shard] = seen.get(shard, 0) + loads.get(slot, (0, 0))[0]
    table = spark.createDataFrame(rows, "virtual_slot int, shard int, base long")
    before = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("copies").over(before), F.lit(0))
    placed = digests.withColumn("_first", first).join(F.broadcast(table), "virtual_slot")
    first, last = F.col("base") + F.col("_first"), F.col("base") + F.col("_first") + F.col("copies") - 1
    runs = placed.withColumn("_last", last).withColumn("_from", F.explode(F.sequence(first, last, F.lit(RUN).cast("long"))))  # no array holds all copies
    each = F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + RUN - 1, F.col("_last"))))
    return runs.select("doc_id", "size", "text_crc32", "shard", each.alias("slot"), "virtual_slot")


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None, version: int | None = None) -> DataFrame:
    """Place all records by a stored map: by `version` of the one at map_path, or by a first version that evens the shards' bytes, stored there (or in the scratch folder)."""
    spark = docs.sparkSession
    digests = materialize(record_digests(docs, slots), "digests")
    loads = {r["virtual_slot"]: (r["rows"], r["bytes"]) for r in slot_loads(digests).collect()}  # at most `slots` rows
    if version is None:
        map_path, version = map_path or new_path(spark, "slot-map"), 1
        save_map(spark, plan_map({k: v[1] for k, v in loads.items()}, slots, shards), map_path, version)
    return place(digests, loads, load_map(spark, map_path, version))


def rebalance(docs: DataFrame, map_path: str, shards: int, slots: int = SLOTS) -> int:
    """Store the next version of a map for `shards` shards and today's loads; its number."""
    spark = docs.sparkSession
    loads = {r["virtual_slot"]: r["bytes"] for r in slot_loads(record_digests(docs, slots)).collect()}  # at most `slots` rows
    last = spark.read.parquet(map_path).agg(F.max("version")).first()[0]
    save_map(spark, edit_map(load_map(spark, map_path, last), loads, shards), map_path, last + 1)
    return last + 1


def op5_fixed_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


# slots in falling order of bytes, each to the shard with the fewest bytes so far
ORACLE = f"""
WITH RECURSIVE t AS MATERIALIZED (SELECT {CRC_TABLE_SQL} AS tab),
d AS MATERIALIZED (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, CAST({crc_sql("hex", "tab")} AS BIGINT) AS text_crc32 FROM (SELECT *, hex(encode(coalesce(text, ''))) AS hex FROM documents), t),
v AS MATERIALIZED (SELECT *, CAST(CAST('0x' || substr(md5(doc_id || '/' || size || '/' || text_crc32), 1, 15) AS BIGINT) % {SLOTS} AS INT) AS virtual_slot FROM d),
l AS MATERIALIZED (SELECT n AS virtual_slot, bytes, row_number() OVER (ORDER BY bytes DESC, n) AS k FROM (SELECT r.n, coalesce(sum(size), 0) AS bytes FROM range({SLOTS}) r(n) LEFT JOIN v ON v.virtual_slot = r.n GROUP BY r.n)),
g(k, virtual_slot, shard, loads) AS (
  SELECT 0::BIGINT, -1::BIGINT, -1, list_transform(range({SHARDS}), lambda i: 0::HUGEINT)
  UNION ALL
  SELECT l.k, l.virtual_slot, CAST(list_position(loads, list_min(loads)) - 1 AS INT), list_transform(loads, lambda x, i: x + CASE WHEN i = list_position(loads, list_min(loads)) THEN l.bytes ELSE 0 END)
  FROM g JOIN l ON l.k = g.k + 1)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY v.virtual_slot, doc_id, text_crc32, size) - 1 AS slot, NULL::INT AS grown_shard, v.virtual_slot
FROM v JOIN g ON g.virtual_slot = v.virtual_slot
"""

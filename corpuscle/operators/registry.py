"""The registry's relational operations: filters, pages, statistics, and changes as new tables.

Changes never edit rows in place: each returns the next state of a table, to be written as a new version.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KB_FILES = T.StructType([T.StructField(n, t) for n, t in (
    ("filename", T.StringType()), ("md5", T.StringType()), ("file_type", T.StringType()), ("region", T.StringType()), ("city", T.StringType()), ("size", T.LongType()), ("chunk_count", T.IntegerType()),
    ("updated_at", T.TimestampType()), ("status", T.StringType()), ("message", T.StringType()), ("sensitive", T.BooleanType()),
)])
DOCUMENT_STATES = ["pending", "queued", "processing", "completed", "failed"]
FILE_STATES = ["ready", "failed", "building"]
LIMITS = {"task_type": (0, 50), "original_text": (0, 4000), "requirements": (0, 1000), "filename": (1, 100), "username": (2, 64), "password": (8, 128)}


def ascii_ilike(c: Column, pattern: str) -> Column:
    """LIKE that folds only ASCII letters; % and _ in the pattern are wildcards."""
    fold = lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return fold(c).like(pattern.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def list_files(files: DataFrame, keyword: str | None = None, **equal: str | None) -> DataFrame:
    """Files by keyword in their name and by equal columns; empty arguments do not filter.  In the order of names."""
    for column, value in equal.items():
        if value:
            files = files.filter(F.col(column) == value)
    if keyword:
        files = files.filter(ascii_ilike(F.col("filename"), f"%{keyword}%"))
    return files.orderBy("filename")


def list_log(log: DataFrame, username: str | None = None, action: str | None = None, success: int | None = None) -> DataFrame:
    if username:
        log = log.filter(ascii_ilike(F.col("username"), f"%{username}%"))
    if action:
        log = log.filter(F.col("action") == action)
    if success is not None:
        log = log.filter(F.col("success") == success)
    return log


def page(rows: DataFrame, order: list[Column], number: int, size: int, default: int = 20, most: int = 100, clamp: bool = True) -> DataFrame:
    """One page.  Page numbers start at 1; a size below 1 is the default, above `most` it is `most` (or the default)."""
    number = max(number, 1)
    size = default if size < 1 else (most if clamp else default) if size > most else size
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def log_page(log: DataFrame, number: int = 1, size: int = 50, **filters) -> tuple[DataFrame, DataFrame]:
    """(rows, total) of the audit log, newest first."""
    found = list_log(log, **filters)
    return page(found, [F.desc("ts"), F.desc("id")], number, size, default=50, most=200, clamp=False), found.agg(F.count(F.lit(1)).alias("total"))


def point(table: DataFrame, key: str, value) -> DataFrame:
    return table.filter(F.col(key) == value)


def insert(table: DataFrame, new: DataFrame) -> DataFrame:
    return table.unionByName(new, allowMissingColumns=True)


def upsert(table: DataFrame, new: DataFrame, key: str, keep: list[str] = (), order: str | None = None) -> DataFrame:
    """Rows of new replace those of equal keys, nulls included; columns in `keep` stay as they were.

    Of several new rows of a key the last by `order` counts (any one without it).
    """
    columns = table.columns
    if order:
        new = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")
    else:
        new = new.dropDuplicates([key])
    o, n = table.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    there = F.col("n._new").isNotNull()

    def value(c: str) -> Column:
        if c == key:
            return F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}"))
        if c in keep:
            return F.col(f"o.{c}")
        return F.when(there, F.col(f"n.{c}") if c in new.columns else F.lit(None)).otherwise(F.col(f"o.{c}"))

    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*[value(c).alias(c) for c in columns])


def partial_update(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Only fields that are set change."""
    c = changes.select(F.col(key), *[F.col(x).alias(f"_{x}") for x in changes.columns if x != key])
    joined = table.join(c, key, "left")
    return joined.select(*[F.coalesce(F.col(f"_{x}"), F.col(x)).alias(x) if f"_{x}" in joined.columns else F.col(x) for x in table.columns])


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti").select(*table.columns)


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], keys: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the keys; tables: name -> (table, its column)."""
    return {name: delete(t, keys.select(F.col(key).alias(c)), c) for name, (t, c) in tables.items()}


def set_flag(table: DataFrame, key: str, value, column: str, flag: bool) -> DataFrame:
    return table.withColumn(column, F.when(F.col(key) == value, F.lit(flag)).otherwise(F.col(column)))


def seed(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows are added where their key is missing."""
    return table.unionByName(rows.join(table.select(key), key, "left_anti").select(*rows.columns), allowMissingColumns=True)


def changed(registry: DataFrame, current: DataFrame, force: bool = False) -> DataFrame:
    """Files whose fingerprint differs from the registered one; both (filename, md5)."""
    joined = current.join(registry.select("filename", F.col("md5").alias("_old")), "filename", "left")
    return joined.filter(~F.col("md5").eqNullSafe(F.col("_old")) | F.lit(force)).drop("_old")


def file_detail(files: DataFrame, bodies: DataFrame, name: str | None = None) -> DataFrame:
    """Registry rows with their file's text as `content`, null where the file is missing or can't be read; bodies: (filename, text)."""
    rows = files if name is None else point(files, "filename", name)
    return rows.join(bodies.select("filename", F.col("text").alias("content")), "filename", "left")


def with_trees(files: DataFrame, trees: DataFrame) -> DataFrame:
    """Registry rows with the tree that was stored for them; trees: (filename, tree_json, ...)."""
    return files.join(trees, "filename")


def with_reports(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """Jobs with the content of their report, null without one; reports: (id, report_content)."""
    return jobs.join(reports.select("id", "report_content"), "id", "left")


def list_users(users: DataFrame) -> DataFrame:
    return users.orderBy("id")


def orphans(indexed: DataFrame, registered: DataFrame) -> DataFrame:
    return indexed.select("source").distinct().join(registered.select(F.col("filename").alias("source")), "source", "left_anti")


def status_counts(table: DataFrame, states: list[str]) -> DataFrame:
    """(status, n): the named states with zeros, and any others there are."""
    fixed = table.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, states))).alias("status"))
    n = table.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return fixed.join(n, "status", "full").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"))


def backfill(files: DataFrame, meta: DataFrame, national: str = "国家法律", local: str = "地方法规") -> DataFrame:
    """Facets of files that lack any, from the index's metadata (source, file_type, region, city), else from their names."""
    lacks = F.lit(False)
    for c in ("file_type", "region", "city"):
        lacks = lacks | (F.coalesce(F.col(c), F.lit("")) == "")
    m = meta.select(F.col("source").alias("filename"), *[F.col(c).alias(f"_{c}") for c in ("file_type", "region", "city")])
    guess = F.when(F.col("filename").startswith("中华人民共和国"), national).otherwise(local)
    joined = files.join(m, "filename", "left")
    new = {"file_type": F.coalesce(F.nullif(F.col("_file_type"), F.lit("")), guess), "region": F.coalesce("_region", F.lit("")), "city": F.coalesce("_city", F.lit(""))}
    return joined.select(*[F.when(lacks, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in files.columns])


def first_meta(chunks: DataFrame) -> DataFrame:
    """The metadata of the first chunk of each source."""
    first = F.min_by(F.struct("file_type", "region", "city"), "chunk")
    return chunks.groupBy("source").agg(first.alias("m")).select("source", "m.*")


def richest(collections: DataFrame) -> DataFrame:
    """The collection with the most distinct sources; collections: (collection, source)."""
    return collections.groupBy("collection").agg(F.countDistinct("source").alias("sources")).orderBy(F.desc("sources"), "collection").limit(1)


def invalid(rows: DataFrame, limits: dict[str, tuple[int, int]] = LIMITS) -> Column:
    """Names of the fields whose lengths are out of bounds, as an array."""
    checks = [F.when(~F.length(c).between(*limits[c]), F.lit(c)) for c in rows.columns if c in limits]
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def known_status(status: Column, states: list[str] = DOCUMENT_STATES) -> Column:
    return F.coalesce(status.isin(states), F.lit(False))


def check_status(value: str, states: list[str] = DOCUMENT_STATES) -> str:
    if value not in states:
        raise ValueError(f"unknown status {value!r}; known: {', '.join(states)}")
    return value


BOUNDS = 256


def global_ranks(values: DataFrame, column: str) -> DataFrame:
    """(column, _rank) of distinct values, from 1 on, without one task that sorts them all.

    Bounds from a bounded sample cut the values into ranges of like size; the counts of the ranges give each its base.
    """
    spark = values.sparkSession
    sample = sorted(r[0] for r in values.orderBy(F.xxhash64(column), column).limit(16 * BOUNDS).collect() if r[0] is not None)
    kind = values.schema[column].dataType.simpleString()
    bounds = F.from_json(F.lit(json.dumps([str(x) for x in sample[:: max(1, len(sample) // BOUNDS)]])), "array<string>").cast(f"array<{kind}>")
    ranged = values.withColumn("_range", F.size(F.filter(bounds, lambda b: b <= F.col(column))))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    base = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # a row a range
    within = F.row_number().over(Window.partitionBy("_range").orderBy(column))
    return ranged.withColumn("_at", within).join(F.broadcast(base), "_range").select(column, (F.col("_base") + F.col("_at")).alias("_rank"))


def even_sample(rows: DataFrame, count: int, order: str) -> DataFrame:
    """`count` rows evenly spaced by rank: round-half-even(i (n - 1) / (count - 1)).  Values of `order` are distinct."""
    if count <= 1:
        return rows.orderBy(order).limit(max(count, 0))
    ranked = global_ranks(rows.select(order), order)
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    wanted = n.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(count - 1)).cast("long") + 1)).alias("_rank")).distinct()
    return rows.join(F.broadcast(ranked.join(F.broadcast(wanted), "_rank").select(order)), order, "left_semi")  # `count` rows

"""Shared plumbing of the training-data operators: scratch tables, row identity, byte-level word tables."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Where that is unset, one is made if this machine runs all tasks (a local master); a cluster must name one.
    """
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("corpuscle.scratch", None)
    if not known:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        known = "file://" + tempfile.mkdtemp(prefix="corpuscle-")
        spark.conf.set("corpuscle.scratch", known)
    return known.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """This application's own folder in the shared one."""
    return f"{shared_dir(spark)}/corpuscle-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that operators of this application have written; results that were not saved can't be read afterwards."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """Arrow batches of few rows while an action runs: they are whole texts, and both sides hold several batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def lean_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """The session's Arrow batches have `rows` rows at most from now on: for plans over whole texts that run later."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "0")) <= rows:
        spark.conf.set(key, str(rows))


def trim() -> None:
    """Give freed memory back to the system: a Python worker lives on beside the next stage's work."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run):
    """run, a generator over a partition's batches, that trims at its end."""

    def whole(batches):
        yield from run(batches)
        trim()

    return whole


def materialize(df: DataFrame, label: str, rows: int = BATCH_ROWS) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut, and losing executors loses nothing.

    rows: of an Arrow batch meanwhile.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    with small_batches(spark, rows):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_ids(docs: DataFrame, text: str = "text") -> Column:
    """Identity of a text as a 64-bit number that different texts of docs do not share; copies share it, null texts have none.

    It is a hash; texts whose hashes meet are told by a second one (128 bits in all) and take that as their number.
    """
    one, two = F.xxhash64(F.col(text)), F.xxhash64(F.lit(1), F.col(text))
    met = docs.filter(F.col(text).isNotNull()).groupBy(one.alias("one")).agg(F.min(two).alias("a"), F.max(two).alias("b")).filter("a != b")
    again = [r["one"] for r in met.select("one").collect()]  # a hundred of 5 * 10**10 texts
    number = F.when(one.isin(again), two).otherwise(one) if again else one
    return F.when(F.col(text).isNotNull(), number)


def rekeyed(df: DataFrame, key: str, *aggs) -> DataFrame:
    """groupBy(key) whose output is hashed on (key, a function of key), so that a join on key adds its own exchange.

    Adaptive execution splits a skewed partition only where both inputs of a join are such exchanges.
    """
    return df.groupBy(key, F.pmod(F.col(key), F.lit(2)).alias("_half")).agg(*aggs).drop("_half")


# ---------------------------------------------------------------------------- words as numpy tables

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (np.uint64(self.base), np.uint64(self.inv)))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS, _WORDS2 = _Powers(_BASE), _Powers(0xD6E8FEB86659FD93), _Powers(0xA0761D6478BD642F)
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array without copying, and the offsets of its rows; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = texts.type in (pa.large_string(), pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(off) and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(texts: pa.Array, most: int = 1 << 21):
    """(first, last) row ranges of at most `most` bytes each, or of a single longer row."""
    _, off = text_buffer(texts)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a slice of texts: byte ranges, document of each word, 64-bit hash of each word."""

    def __init__(self, texts: pa.Array, hashed: bool = True) -> None:
        self.raw, self.off = text_buffer(texts)
        raw, n = self.raw, len(self.raw)
        self.docs = len(self.off) - 1
        solid = ~_SPACE[raw]
        edge = np.zeros(n + 1, bool)
        edge[self.off] = True
        before = np.empty(n, bool)
        if n:
            before[0] = True
            before[1:] = ~solid[:-1]
        self.start = np.flatnonzero(solid & (before | edge[:-1]))
        after = np.empty(n, bool)
        if n:
            after[-1] = True
            after[:-1] = ~solid[1:]
        self.end = np.flatnonzero(solid & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.off)  # the first word of each document, and the number of words
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.docs), self.count)
        if hashed:
            up, down = _BYTES.get(n + 1)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_TABLE[raw] * up[:n], out=total[1:])
            h = (total[self.end] - total[self.start]) * down[self.start]
            self.hash = mix(h ^ ((self.end - self.start).astype(np.uint64) * _M2))

    def windows(self, size: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Positions (word numbers of the slice) at which `size` words of one document start, and their 64-bit hashes."""
        n = len(self.start)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[: n - size + 1] == self.doc[size - 1 :])
        up, down = (_WORDS2 if second else _WORDS).get(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((mix(self.hash) if second else self.hash) * up[:n], out=total[1:])
        return at, mix((total[at + size] - total[at]) * down[at])


# ---------------------------------------------------------------------------- SQL for oracles

# CRC-32 in DuckDB: its table, and the value for a column of hex digits
CRC_TABLE_SQL = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"


def crc_sql(digits: str, table: str) -> str:
    """The unsigned CRC-32 of the bytes in hex `digits`; table: a column with CRC_TABLE_SQL."""
    steps = f"list_transform(range(length({digits}) // 2), lambda i: CAST('0x' || substr({digits}, CAST(2 * i + 1 AS INT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, b: xor(c >> 8, {table}[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295)"


# ---------------------------------------------------------------------------- groups in sorted batches


def whole_groups(batches, names: list[str]):
    """Tables of whole groups, one group each, from record batches sorted on integer columns `names`."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in names])
        cut = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            key = tuple(keys[:, a])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


# ---------------------------------------------------------------------------- columns that are only carried along

SPECIAL = ("doc_id", "text", "source", "n_chars")


def aside(docs: DataFrame):
    """docs with all columns but SPECIAL under names that no operator uses, and a function that gives them back."""
    names = docs.columns
    hidden = {c: c if c in SPECIAL else f"_carried{i}" for i, c in enumerate(names)}
    inner = docs.select(*[F.col(f"`{c}`").alias(hidden[c]) for c in names])

    def back(df: DataFrame, *more) -> DataFrame:
        return df.select(*[F.col(hidden[c]).alias(c) for c in names], *more)

    return inner, back

"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source is a queue of blocks.  Block j of a source of weight w is released at floor(j / w) and due at
ceil((j + 1) / w); earliest deadline first then runs in every slot one block that has been released.  Weights are exact
ratios of whole numbers (roots and the like are rounded to 2**-53, as floats are), and the schedule runs over a whole
stretch without a period, so within a stretch no source is ever a whole block from its target, however long it is.

A source that is used up leaves, which ends a stretch; the others go on with their weights scaled up, counted from there.
What a source lacks at the end of a stretch, less than a block, is not made up for in the next one: measured against the sum
of its targets over all stretches a source can be several blocks away (7 with 20 sources that end at 20 different times).

A block is one row, up to STEPS rows; beyond, blocks are so many rows that the schedule has about STEPS steps (`block` sets
it), and the bound is of one such block: 1,200 rows of 2 * 10**10.  The driver runs the schedule, some 2 microseconds a
step, so its time is bounded whatever the corpus holds, and writes it to the shared folder in chunks of bounded size:
a line for each queue and chunk with the slots of the queue's blocks.  Rows find their slots by a join; releases and
deadlines are whole-number arithmetic on the block's number.  The last source left needs no schedule.

The number of a block in its queue needs no global sort: rows are counted by (source, bucket of a hash of the row), the
counts are summed over the buckets, and rows are numbered within a bucket.  A source with a third of all rows is spread
over all buckets.  `mixed` does this with hashes of the rows alone, and brings whole rows to their places afterwards.

Defined results: a null source is a source of its own; a null doc_id, and a null, empty or very long text are rows like
others; repeated rows get places of their own; equal deadlines go to the larger source, then by its name; every source is
a queue, however many there are, and one without a target has a weight of 1e-9; an empty table gives an empty result.
`mixed` keeps all columns whatever their names; `mix_sources` replaces those of its results.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.llm.common import aside, materialize, new_path

BUCKETS = (64, 8192, 100_000)  # least, most, rows a bucket
WHOLE = 1 << 53  # shares of a whole without a period
CHUNK, RUN = 8192, 65536  # slots a chunk, and of the last source
EXPONENT = 0.5
BROADCAST_ROWS = 1 << 20  # hashes of repeated rows, of 8 bytes, that are broadcast
STEPS = 1 << 24  # of a schedule, about: blocks are rows up to that many
LINE = ["queue", "stretch", "low", "start", "share", "whole", "first", "base", "lacking", "blocks"]  # low, first: blocks of the queue before the stretch, the chunk; start, base: slots before them; lacking: rows that blocks before the stretch had too few
RESULT = ["position", "queue_position", "release", "deadline", "stretch"]


def shares(weights: dict[int, float]) -> tuple[dict[int, int], int]:
    """Weights as whole parts of a total: exactly (0.3 is 3 of 10), or else of WHOLE."""
    exact = {q: Fraction(str(float(w))) for q, w in weights.items()}
    unit = Fraction(gcd(*(w.numerator for w in exact.values())), lcm(*(w.denominator for w in exact.values())))
    total = sum(exact.values())
    if total / unit <= WHOLE:
        return {q: int(w / unit) for q, w in exact.items()}, int(total / unit)
    out = {q: max(1, round(w / total * WHOLE)) for q, w in exact.items()}
    out[max(out, key=lambda q: (out[q], -q))] += WHOLE - sum(out.values())
    return out, WHOLE


def schedule(sizes: dict[int, int], weights: dict[int, float], block: int = 1):
    """Lines of LINE, and the blocks' slots in the chunk; without slots the blocks are next to each other.  sizes: rows."""
    left, at, stretch, lacking = {q: -(-n // block) for q, n in sizes.items() if n > 0}, 0, 0, 0
    done = dict.fromkeys(left, 0)
    while len(left) > 1:
        share, whole = shares({q: weights[q] for q in left})
        count, waiting, slot, ended = dict.fromkeys(left, 0), [(0, q) for q in sorted(left)], 0, False
        ready: list[tuple[int, int]] = []
        while not ended:
            base, before, own = slot, dict(count), defaultdict(list)
            while slot < base + CHUNK and not ended:
                while waiting and waiting[0][0] <= slot:
                    q = heapq.heappop(waiting)[1]
                    heapq.heappush(ready, (-(-(count[q] + 1) * whole // share[q]), q))
                q = heapq.heappop(ready)[1]
                own[q].append(slot - base)
                count[q] += 1
                slot += 1
                ended = count[q] == left[q]
                heapq.heappush(waiting, (count[q] * whole // share[q], q))
            for q, slots in own.items():
                yield q, stretch, done[q], at, share[q], whole, done[q] + before[q], at + base, lacking, len(slots), slots
        for q, n in count.items():
            done[q] += n
            left[q] -= n
            if not left[q]:  # its last block ended the stretch, and may have fewer rows
                lacking += done[q] * block - sizes[q]
        left = {q: n for q, n in left.items() if n}
        at += slot
        stretch += 1
    for q, n in left.items():
        for i in range(0, n, RUN):
            yield q, stretch, done[q], at, 1, 1, done[q] + i, at + i, lacking, min(RUN, n - i), []


def stored(spark: SparkSession, lines) -> DataFrame:
    """A schedule as a table with a row a block: (queue, block_number, slot, lacking, stretch, low, start, share, whole)."""
    path, n, part = new_path(spark, "schedule"), 0, []
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/lines.txt")
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    for *numbers, slots in lines:
        part.append("|".join([*map(str, numbers), ",".join(map(str, slots))]) + "\n")
        n += 1
        if len(part) == 1024:
            out.write(bytearray("".join(part).encode()))
            part.clear()
    out.write(bytearray("".join(part).encode()))
    out.close()
    cell = F.split("value", r"\|")
    table = spark.read.text(path).repartition(n // 64 + 1, "value").select(*[cell[i].cast("long").alias(c) for i, c in enumerate(LINE)], cell[len(LINE)].alias("slots"))
    slots = F.when(F.col("slots") == "", F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.split("slots", ",").cast("array<long>"))
    each = table.select(*LINE[:-1], F.posexplode(slots).alias("i", "own"))
    return each.select(F.col("queue").cast("int").alias("queue"), (F.col("first") + F.col("i")).alias("block_number"), (F.col("base") + F.col("own")).alias("slot"), "lacking", F.col("stretch").cast("int").alias("stretch"), "low", "start", "share", "whole")


def queue_sizes(docs: DataFrame) -> list[tuple[str | None, int]]:
    """(source, rows) of all sources, largest first: a row a source."""
    counts = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return [(r["source"], r["n"]) for r in counts.orderBy(F.desc("n"), F.col("source")).collect()]


def queue_table(spark: SparkSession, sources: list[str | None]) -> DataFrame:
    """(_source, _queue), out of a literal: without Python or RDDs."""
    rows = F.from_json(F.lit(json.dumps([{"s": s, "q": q} for q, s in enumerate(sources)])), "array<struct<s string, q int>>")
    return spark.range(1).select(F.inline(rows)).toDF("_source", "_queue")


def default_weights(docs: DataFrame) -> dict[str | None, float]:
    """Weight of each source where no targets are given: its number of rows to the power EXPONENT."""
    return {s: n**EXPONENT for s, n in queue_sizes(docs)}


def spread(cols: list[str]) -> Column:
    """A hash of a row that is the same wherever the row lies."""
    return F.xxhash64(*[F.col(c) for c in cols])


def scheduled(docs: DataFrame, key: list[str], targets: dict[str | None, float] | None, exponent: float, block: int | None, buckets: int | None) -> DataFrame:
    """docs, none of whose columns starts with a line, with RESULT under names that do."""
    spark = docs.sparkSession
    every = queue_sizes(docs)
    total = sum(n for _, n in every)
    if not total:
        return docs.select("*", *[F.lit(0).cast("long").alias(f"_{c}") for c in RESULT[:4]], F.lit(0).alias("_stretch"))
    buckets = buckets or min(BUCKETS[1], max(BUCKETS[0], total // BUCKETS[2]))
    block = block or -(-total // STEPS)
    sizes = {i: n for i, (_, n) in enumerate(every)}
    weights = {i: (targets.get(s, 0) or 1e-9) if targets else n**exponent for i, (s, n) in enumerate(every)}
    queues = F.broadcast(queue_table(spark, [s for s, _ in every]))  # a row a source
    rows = docs.join(queues, docs["source"].cast("string").eqNullSafe(queues["_source"])).drop("_source")
    rows = rows.withColumn("_hash", spread(key)).withColumn("_bucket", F.pmod("_hash", F.lit(buckets)).cast("int"))

    counts = rows.groupBy("_queue", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    up_to = Window.partitionBy("_queue").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # of `buckets` rows
    base = counts.select("_queue", "_bucket", F.coalesce(F.sum("_n").over(up_to), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_queue", "_bucket").orderBy("_hash", *key)
    numbered = rows.withColumn("_number", F.row_number().over(within) - 1).join(base, ["_queue", "_bucket"])
    numbered = numbered.withColumn("_queue_position", F.col("_base") + F.col("_number")).withColumn("_block", F.expr(f"_queue_position div {block}"))

    table = stored(spark, schedule(sizes, weights, block)).withColumnsRenamed({"queue": "_queue", "block_number": "_block", "stretch": "_stretch"}).hint("merge")  # a row a block
    out = numbered.join(table, ["_queue", "_block"])
    part = "cast({0} AS decimal(20,0)) * cast(whole AS decimal(17,0))"
    release = F.col("start") + F.expr(f"({part.format('_block - low')}) div cast(share AS decimal(17,0))")
    due = F.col("start") + F.expr(f"({part.format('_block - low + 1')} + cast(share - 1 AS decimal(17,0))) div cast(share AS decimal(17,0))")
    position = F.col("slot") * block - F.col("lacking") + F.pmod("_queue_position", F.lit(block))
    return out.select(*docs.columns, position.alias("_position"), "_queue_position", release.alias("_release"), due.alias("_deadline"), "_stretch")


def mix_sources(docs: DataFrame, targets: dict[str | None, float] | None = None, *, exponent: float | None = None, block: int | None = None, buckets: int | None = None, key: list[str] | None = None) -> DataFrame:
    """All rows of docs (a column with the name of a result is replaced), with `position` (0, 1, ... in the mixed order), queue_position, stretch, release and deadline (in slots).

    targets: weight of each source; by default its number of rows to the power `exponent` (EXPONENT).
    block: rows of a block.
    key: the columns that tell rows apart and shuffle each queue, doc_id and text by default.
    """
    docs = docs.drop(*RESULT)
    docs, back = aside(docs) if key is None else (docs, lambda df, *more: df.select(*docs.columns, *more))
    key = key or [c for c in ("doc_id", "text") if c in docs.columns]
    return back(scheduled(docs, key, targets, EXPONENT if exponent is None else exponent, block, buckets), *[F.col(f"_{c}").alias(c) for c in RESULT])


def mixed(docs: DataFrame, targets: dict[str | None, float] | None = None) -> DataFrame:
    """The documents in their mixed order; columns as they were, whatever their names."""
    inner, back = aside(docs)
    wide = inner.withColumn("_row", spread([c for c in ("source", "doc_id", "text") if c in docs.columns]))
    same = Window.partitionBy("_row")
    places = scheduled(wide.select("source", "_row"), ["_row"], targets, EXPONENT, None, None).select("_row", "_position")
    places = places.select("*", F.count(F.lit(1)).over(same).alias("_copies"), (F.row_number().over(same.orderBy("_position")) - 1).alias("_nth"))
    places = materialize(places, "places")
    # whole rows are moved to their places' hashes and then in order; rows of one hash, which are few, take their places in turn
    once = wide.join(places.filter("_copies = 1").select("_row", "_position"), "_row")
    repeated = places.filter("_copies > 1 AND _nth = 0").select("_row")
    if many := repeated.count():
        rows = wide.join(F.broadcast(repeated) if many <= BROADCAST_ROWS else repeated, "_row", "left_semi").withColumn("_nth", F.row_number().over(same.orderBy("_row")) - 1)
        once = once.unionByName(rows.join(places.filter("_copies > 1").select("_row", "_nth", "_position"), ["_row", "_nth"]).drop("_nth"))
    return back(once.orderBy("_position"))


def op9_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", F.octet_length("text").cast("long").alias("size"), F.xxhash64("text").alias("text_id"))
    return mix_sources(docs, key=["doc_id", "text_id"]).drop("text_id")

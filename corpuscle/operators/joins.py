"""Joins that Spark lacks: as-of and range, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """left with the values of right's last row of equal keys at or before `at`; of equal times the greatest values.

    Both sides are united and read once in time order within a key; nothing is paired.
    """
    l = left.select("*", F.lit(1).alias("_side"), *[F.lit(None).cast(right.schema[v].dataType).alias(f"_v_{v}") for v in values])  # noqa: E741
    r = right.select(*keys, at, F.lit(0).alias("_side"), *[F.col(v).alias(f"_v_{v}") for v in values])
    both = l.unionByName(r, allowMissingColumns=True)
    held = F.when(F.col("_side") == 0, F.struct(*[F.col(f"_v_{v}").alias(v) for v in values]))
    by = Window.partitionBy(*keys).orderBy(at, "_side", *[f"_v_{v}" for v in values]).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_last", F.last(held, ignorenulls=True).over(by)).filter("_side = 1")
    return out.select(*left.columns, *[F.col(f"_last.{v}").alias(v) for v in values])


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: int, keys: list[str] = ()) -> DataFrame:
    """Points within [low, high], by an equi-join on bins of `width` that each range covers."""
    p = points.withColumn("_bin", F.floor(F.col(at) / width))
    r = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, [*keys, "_bin"]).filter((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("_bin")

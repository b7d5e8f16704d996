"""Connected components of a table of edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.common import materialize, rekeyed


def _star(edges: DataFrame, lowest: DataFrame) -> DataFrame:
    return edges.join(lowest, "u")


def _step(edges: DataFrame) -> DataFrame:
    """edges (u, v) with u > v, one large-star and one small-star step on."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = rekeyed(both, "u", F.min(F.least("u", "v")).alias("m"))
    large = _star(both, lowest).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    lowest = rekeyed(large, "u", F.min("v").alias("m"))
    joined = _star(large, lowest)
    pairs = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return pairs.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, v): v is the least node of u's component; least nodes themselves are not listed.

    Every round is written to the shared folder, so lineage stays short.  A component is never gathered in one place.
    """
    now = edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(now, "edges")
    mark = _mark(now)
    for _ in range(most_rounds):
        if not mark[0]:
            return now
        new = materialize(_step(now), "edges")
        after = _mark(new)
        now = new
        if after == mark:
            return now
        mark = after
    raise RuntimeError("the components did not settle")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

"""Array arithmetic of image models as expressions: sizes, positions, weights, placeholder runs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_ASPECT = 200


def fitted_size(height: Column, width: Column, factor: int, least: int, most: int) -> Column:
    """(height, width) as multiples of factor whose product lies between least and most; null beyond the aspect limit."""
    area = (height * width).cast("double")
    near = lambda x: F.bround(x / F.lit(float(factor))) * factor
    shrink, grow = F.sqrt(area / most), F.sqrt(F.lit(float(least)) / area)
    down = lambda x: F.greatest(F.lit(float(factor)), F.floor(x / shrink / factor) * factor)
    up = lambda x: F.ceil(x * grow / factor) * factor
    h, w = near(height), near(width)
    pair = lambda a, b: F.struct(a.cast("int").alias("height"), b.cast("int").alias("width"))
    fitted = F.when(h * w > most, pair(down(height), down(width))).when(h * w < least, pair(up(height), up(width))).otherwise(pair(h, w))
    return F.when(F.greatest(height, width) / F.least(height, width) <= MOST_ASPECT, fitted)


def grid_tokens(grids: DataFrame, merge: int) -> DataFrame:
    """grids (t, h, w, ...) with a row a token: `token`, its `row` and `col`, block by block of merge x merge cells.

    With several frames the tokens of a cell stand together.
    """
    cells = F.col("h") * F.col("w")
    rows = grids.select("*", F.explode(F.sequence(F.lit(0), F.col("t") * cells - 1)).alias("token"))
    cell = F.floor(F.col("token") / F.col("t"))
    inner, block = F.pmod(cell, F.lit(merge * merge)), F.floor(cell / (merge * merge))
    across = F.floor(F.col("w") / merge)
    row = F.floor(block / across) * merge + F.floor(inner / merge)
    col = F.pmod(block, across) * merge + F.pmod(inner, F.lit(merge))
    return rows.select("*", row.cast("int").alias("row"), col.cast("int").alias("col"))


def bilinear(tokens: DataFrame, side: int) -> DataFrame:
    """tokens (h, w, row, col) with `indices` and `weights` of the four neighbours in a side x side grid."""

    def axis(i: Column, n: Column) -> tuple[Column, Column, Column]:
        at = F.when(n > 1, i * F.lit(float(side - 1)) / (n - 1)).otherwise(0.0)
        low = F.floor(at)
        return low, F.least(low + 1, F.lit(side - 1)), at - low

    (r0, r1, dr), (c0, c1, dc) = axis(F.col("row"), F.col("h")), axis(F.col("col"), F.col("w"))
    indices = F.array(*[(r * side + c).cast("int") for r in (r0, r1) for c in (c0, c1)])
    weights = F.array(*[(a * b).cast("float") for a in (1 - dr, dr) for b in (1 - dc, dc)])
    return tokens.select("*", indices.alias("indices"), weights.alias("weights"))


def rope_positions(segments: DataFrame, merge: int) -> DataFrame:
    """(seq, segment, k, t, h, w): three positions of each token of sequences of text and images.

    segments: (seq, segment, length, grid_t, grid_h, grid_w), grids null for text.  Text counts on in all three; an image
    starts where the text before it ends, counts by its own axes, and what follows goes on after its longest axis.
    """
    gh, gw = F.floor(F.col("grid_h") / merge), F.floor(F.col("grid_w") / merge)
    image = F.col("grid_t").isNotNull()
    span = F.when(image, F.greatest(F.col("grid_t"), gh, gw)).otherwise(F.col("length"))
    before = Window.partitionBy("seq").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    rows = segments.withColumn("_start", F.coalesce(F.sum(span).over(before), F.lit(0)))
    size = F.when(image, F.col("grid_t") * gh * gw).otherwise(F.col("length"))
    rows = rows.filter(size > 0).select("*", F.explode(F.sequence(F.lit(0), (size - 1).cast("int"))).alias("k"))
    k, start = F.col("k"), F.col("_start")
    axes = {"t": F.floor(k / (gh * gw)), "h": F.pmod(F.floor(k / gw), gh), "w": F.pmod(k, gw)}
    return rows.select("seq", "segment", "k", *[(start + F.when(image, a).otherwise(k)).cast("int").alias(n) for n, a in axes.items()])


def expand_pads(ids: Column, sizes: Column, pad: int) -> Column:
    """ids with the n-th pad repeated sizes[n] times (once at least); null if their numbers differ."""
    zero = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        run = F.array_repeat(x, F.greatest(F.coalesce(F.get(sizes, acc["n"]), F.lit(1)), F.lit(1)).cast("int"))
        return F.when(x == pad, F.struct(F.concat(acc["out"], run).alias("out"), (acc["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(acc["out"], F.array(x)).alias("out"), acc["n"].alias("n")))

    whole = F.aggregate(F.transform(ids, lambda x: x.cast("bigint")), zero, step, lambda acc: acc["out"])
    return F.when(F.size(F.filter(ids, lambda x: x == pad)) == F.size(sizes), whole)


def patches(image: np.ndarray, patch: int, merge: int, frames: int = 1) -> np.ndarray:
    """Rows of patches of a (channel, height, width) image in the order of `grid_tokens`; for use in Arrow functions."""
    c, height, width = image.shape
    rows, cols = height // patch, width // patch
    cut = image.reshape(c, rows, patch, cols, patch).transpose(1, 3, 0, 2, 4)
    order = [(br * merge + i) * cols + bc * merge + j for br in range(rows // merge) for bc in range(cols // merge) for i in range(merge) for j in range(merge)]
    flat = cut.reshape(rows * cols, c, 1, patch * patch)[order]
    return np.repeat(flat, frames, axis=2).reshape(rows * cols, -1)


def normalised(image: np.ndarray, mean: list[float], deviation: list[float]) -> np.ndarray:
    """A (channel, height, width) image of bytes scaled to [0, 1], less the mean, over the deviation."""
    return (image.astype(np.float32) / 255 - np.asarray(mean, np.float32)[:, None, None]) / np.asarray(deviation, np.float32)[:, None, None]

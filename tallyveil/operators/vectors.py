"""Transformations of vectors (cell, value) and partitions (cell, part), as plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coordinates(x: DataFrame, shape: tuple[int, ...]) -> DataFrame:
    """Adds b0.. to a flat vector."""
    step = 1
    steps = []
    for n in reversed(shape):
        steps.append(step)
        step *= n
    for i, (n, s) in enumerate(zip(shape, reversed(steps), strict=True)):
        x = x.withColumn(f"b{i}", F.expr(f"(cell div {s}) % {n}"))
    return x


def reduce_by(x: DataFrame, parts: DataFrame) -> DataFrame:
    """Sums of cells by part, numbered in order of part id: (cell, value). Partitions are data-independent and dense."""
    return x.join(parts, "cell").groupBy(F.col("part").alias("cell")).agg(F.sum("value").alias("value"))


def expand_by(reduced: DataFrame, parts: DataFrame) -> DataFrame:
    """Each part's value spread evenly over its cells. Sizes come from an aggregate, so a large part is many rows, not a task."""
    sizes = parts.groupBy("part").agg(F.count("*").alias("size"))
    return parts.join(sizes, "part").join(reduced.select(F.col("cell").alias("part"), "value"), "part").select("cell", (F.col("value") / F.col("size")).alias("value"))


def split_by(x: DataFrame, parts: DataFrame) -> DataFrame:
    """(part, cell, value) with cells renumbered inside each part: all sub-vectors in one frame."""
    local = F.row_number().over(Window.partitionBy("part").orderBy("cell")) - 1
    return x.join(parts, "cell").select("part", local.cast("long").alias("local"), "value")


def masked(x: DataFrame, mask: Column) -> DataFrame:
    return x.select("cell", F.when(mask, F.col("value")).otherwise(0).alias("value"))


def canonical(parts: DataFrame) -> DataFrame:
    """Parts renumbered by their first cell. The window runs over one row a part."""
    first = parts.groupBy("part").agg(F.min("cell").alias("first"))
    order = first.withColumn("number", (F.row_number().over(Window.orderBy("first")) - 1).cast("long"))
    return parts.join(order.select("part", "number"), "part").select("cell", F.col("number").alias("part"))


def histogram_stats(x: DataFrame) -> DataFrame:
    return x.agg(F.avg((F.col("value") != 0).cast("double")).alias("nonzero"), F.max("value").cast("double").alias("max_count"), F.sum("value").cast("double").alias("total"))


def grid(n: int, block: int) -> Column:
    """Part of a 1-D grid."""
    if n % block:
        raise ValueError("the block must divide the domain")
    return F.expr(f"cell div {block}")


def hilbert(side: int) -> Column:
    """Place on the Hilbert curve of cell (i, j) of a square grid, from columns b0 and b1. side: a power of two.

    Each level reads one bit of both coordinates and turns the rest; unrolled, it is one column expression.
    """
    x, y, d, s = F.col("b0").cast("long"), F.col("b1").cast("long"), F.lit(0).cast("long"), side // 2
    while s:
        rx, ry = F.expr("0") + F.when(F.floor(x / s) % 2 == 1, 1).otherwise(0), F.expr("0") + F.when(F.floor(y / s) % 2 == 1, 1).otherwise(0)
        d = d + F.lit(s * s) * ((3 * rx).bitwiseXOR(ry))
        nx, ny = F.when((ry == 0) & (rx == 1), F.lit(s - 1) - x % s).otherwise(x % s), F.when((ry == 0) & (rx == 1), F.lit(s - 1) - y % s).otherwise(y % s)
        x, y = F.when(ry == 0, ny).otherwise(nx), F.when(ry == 0, nx).otherwise(ny)
        s //= 2
    return d.cast("long")

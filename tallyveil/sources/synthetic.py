"""Synthetic histograms. Draws are hashes of a seed and a row's number, so a data set is the same under any partitioning."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyveil.functions import noise
from tallyveil.operators.workload import frame
from tallyveil.sources.relation import dense


def sampled(shares: DataFrame, n_cells: int, size: int, seed: str) -> DataFrame:
    """The histogram of `size` draws with replacement. shares: (cell, share), not negative; they need not sum to 1.

    Each draw finds its cell by a range of the running sum. Those ranges go to every task as one sorted array of the domain's
    size, searched by bisection, so draws are never joined or shuffled.
    """
    spark = shares.sparkSession
    rows = shares.where("share > 0").orderBy("cell").toArrow()
    cell, upto = rows.column("cell").to_numpy(), np.cumsum(rows.column("share").to_numpy().astype(float))
    known = spark.sparkContext.broadcast((cell, upto))

    def draw(batches):
        cells, ends = known.value
        for b in batches:
            at = np.searchsorted(ends, b["u"].to_numpy() * ends[-1], side="right")
            found, count = np.unique(cells[np.minimum(at, len(cells) - 1)], return_counts=True)
            yield pd.DataFrame({"cell": found, "count": count})

    draws = spark.range(size).select(noise.uniform(seed, F.col("id")).alias("u"))
    counts = draws.mapInPandas(draw, "cell long, count long").groupBy("cell").agg(F.sum("count").alias("value"))
    return dense(counts, n_cells)


def uniformity(spark: SparkSession, n: int, share: float, scale: float, seed: str) -> DataFrame:
    """A share of the cells, chosen by chance, hold the scale in equal parts; the others hold nothing."""
    filled = max(1, int(share * n))
    order = Window.orderBy(noise.uniform(seed, F.col("id")), "id")
    ranked = spark.range(n).select(F.col("id").alias("cell"), F.row_number().over(order).alias("k"))
    return ranked.select("cell", F.when(F.col("k") <= filled, scale / filled).otherwise(0.0).alias("value"))


def zipf(spark: SparkSession, n: int, size: int, seed: str, empty: float = 0.8, power: float = 1.2) -> DataFrame:
    """`size` draws over the cells that are not left empty; the k-th of them, in an order by chance, has share k ** -power."""
    if power <= 1:
        raise ValueError("the power must be above 1")
    filled = max(1, round(n * (1 - empty)))
    order = Window.orderBy(noise.uniform(f"{seed}/cells", F.col("id")), "id")
    ranked = spark.range(n).select(F.col("id").alias("cell"), F.row_number().over(order).alias("k")).where(F.col("k") <= filled)
    return sampled(ranked.select("cell", F.pow("k", F.lit(-power)).alias("share")), n, size, f"{seed}/draws")


#: The shape of a census-like table: relation, sex, age, hispanic, race.
CENSUS_SHAPE = (17, 2, 115, 2, 63)


def table(spark: SparkSession, size: int, seed: str, shape: tuple[int, ...] = CENSUS_SHAPE, empty: float = 0.8, power: float = 1.2) -> DataFrame:
    """A Zipf histogram over a product domain; vectors.coordinates gives its attributes."""
    return zipf(spark, math.prod(shape), size, seed, empty, power)


def product(spark: SparkSession, marginals: list[list[float]], size: int, seed: str) -> DataFrame:
    """Draws from independent attributes with the given marginal counts or shares, over the product domain."""
    shares = np.ones(1)
    for m in marginals:
        shares = np.outer(shares, np.asarray(m, float) / np.sum(m)).reshape(-1)
    return sampled(frame(spark, cell=np.arange(len(shares)), share=shares), len(shares), size, seed)


def geometric_fill(n: int, total: int, ratio: float) -> list[int]:
    """Whole counts that fall by the ratio and sum to the total; what rounding leaves goes to the first."""
    weights = ratio ** np.arange(n)
    counts = np.floor(total * weights / weights.sum()).astype(int)
    counts[0] += total - counts.sum()
    return counts.tolist()

"""Measurements and private selections. Noise is projected before anything leaves the executors."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyveil.functions import noise
from tallyveil.operators.workload import Matrix


def laplace(m: Matrix, x: DataFrame, eps: float, seed: str) -> DataFrame:
    """(query, value): answers with Laplace noise of the matrix's L1 sensitivity over eps. x must be dense."""
    y = m.apply(x)
    return y.select("query", (F.col("value") + noise.laplace(seed, F.col("query"), m.sensitivity() / eps)).alias("value"))


def noise_deviation(m: Matrix, eps: float) -> float:
    return math.sqrt(2) * m.sensitivity() / eps


def noisy_max(scores: DataFrame, eps: float, seed: str, sensitivity: float = 1.0) -> DataFrame:
    """The query of largest score after Laplace noise: one row."""
    noisy = F.col("value") + noise.laplace(seed, F.col("query"), sensitivity / eps)
    return scores.agg(F.max_by("query", noisy).alias("query"))


def exponential(scores: DataFrame, eps: float, seed: str, sensitivity: float = 1.0) -> DataFrame:
    """The exponential mechanism, drawn as a Gumbel maximum: one row."""
    return scores.agg(F.max_by("query", eps * F.col("value") / (2 * sensitivity) + noise.gumbel(seed, F.col("query"))).alias("query"))


def worst_approximated(m: Matrix, x: DataFrame, estimate: DataFrame, measured: list[int], eps: float, seed: str, mechanism: str = "exponential") -> DataFrame:
    """The query that the estimate answers worst, chosen privately; measured ones score 0."""
    gap = m.apply(x).alias("t").join(m.apply(estimate).alias("e"), "query").select("query", F.abs(F.col("t.value") - F.col("e.value")).alias("value"))
    if measured:
        gap = gap.withColumn("value", F.when(F.col("query").isin(measured), 0.0).otherwise(F.col("value")))
    return (exponential if mechanism == "exponential" else noisy_max)(gap, eps, seed)

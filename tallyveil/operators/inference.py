"""Estimates of a vector from noisy measurements. They see noisy numbers of a declared domain's size, never the table.

Strategies are applied, never written out, but for single queries that are weighed one by one.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyveil.operators.workload import Matrix, Union, as_matrix

Measured = list[tuple[Matrix | np.ndarray, np.ndarray, float]]  # (matrix, answers, noise scale)


def scaled(measured: Measured) -> tuple[Matrix, np.ndarray]:
    """One matrix and its answers, all of one noise scale."""
    return Union([(as_matrix(a), 1 / s) for a, _, s in measured]), np.concatenate([np.asarray(y, float) / s for _, y, s in measured])


def conjugate_gradients(times, transposed, y: np.ndarray, n: int, rounds: int = 2000, tolerance: float = 1e-13, damp: float = 0.0) -> np.ndarray:
    """Least squares from zero by products alone, so of least norm. damp: the weight of the vector's own square."""
    x, r = np.zeros(n), np.array(y, float)
    s = transposed(r)
    p, g = s.copy(), s @ s
    done = tolerance**2 * g
    for _ in range(rounds):
        if g <= done or g == 0:
            break
        q = times(p)
        step = g / (q @ q + damp * (p @ p))
        x, r = x + step * p, r - step * q
        s = transposed(r) - damp * x
        new = s @ s
        p, g = s + new / g * p, new
    return x


def least_squares(measured: Measured, l2: float = 0.0) -> np.ndarray:
    """Of least norm where the strategy has less than full rank."""
    a, y = scaled(measured)
    return conjugate_gradients(a.times, a.transposed, y, a.n, damp=l2)


def largest_stretch(a: Matrix, l2: float = 0.0, rounds: int = 60) -> float:
    """A bound above the largest eigenvalue of the Gram matrix, by power iteration with a margin, but no more than the
    product of the largest row and column sums."""
    whole = a.absolute()
    sure = float(whole.times(np.ones(a.n)).max() * whole.transposed(np.ones(a.m)).max())
    x = np.random.default_rng(0).standard_normal(a.n)
    size = 0.0
    for _ in range(rounds):
        x = a.transposed(a.times(x / (np.linalg.norm(x) or 1)))
        size = float(np.linalg.norm(x))
    return min(sure, 1.1 * size) + l2


def nonnegative(measured: Measured, rounds: int = 2000, l1: float = 0.0, l2: float = 0.0, start: np.ndarray | None = None) -> np.ndarray:
    """Accelerated projected gradient on |Ax - y|^2 / 2 + l1 sum x + l2 |x|^2 / 2 over x >= 0."""
    a, y = scaled(measured)
    rate = 1 / max(largest_stretch(a, l2), 1e-12)
    x = np.maximum(0, least_squares(measured)) if start is None else start
    z, t = x.copy(), 1.0
    for _ in range(rounds):
        new = np.maximum(0, z - rate * (a.transposed(a.times(z) - y) + l2 * z + l1))
        u = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, x, t = new + (t - 1) / u * (new - x), new, u
    return x


def workload_nonnegative(workload: Matrix, measured: Measured, **options: float) -> np.ndarray:
    """A nonnegative vector whose answers to the workload are nearest to those of the least-squares vector."""
    return nonnegative([(workload, workload.times(least_squares(measured)), 1.0)], **options)


def multiplicative_weights(measured: Measured, total: float, rounds: int = 50, start: np.ndarray | None = None) -> np.ndarray:
    """Query by query: x * exp(q * error / 2 total), scaled back to the total."""
    rows = [(q, v) for a, y, _ in measured for q, v in zip(as_matrix(a).numpy(), y, strict=True)]
    n = as_matrix(measured[0][0]).n
    x = np.full(n, total / n) if start is None else start.copy()
    for _ in range(rounds):
        for q, v in rows:
            x = x * np.exp(q * (v - q @ x) / (2 * total))
            x *= total / x.sum()
    return x


def multiplicative_round(estimate: DataFrame, steps: DataFrame, total: float) -> DataFrame:
    """One batch update as a plan. steps: (cell, step) = sum of query weight times error."""
    moved = estimate.join(steps, "cell").select("cell", (F.col("value") * F.exp(F.col("step") / (2 * total))).alias("value"))
    whole = moved.agg(F.sum("value").alias("whole"))
    return moved.crossJoin(F.broadcast(whole)).select("cell", (F.col("value") * total / F.col("whole")).alias("value"))


def threshold(x: DataFrame, n: int, eps: float, ratio: float = 0.35, eta: float = 0.35) -> DataFrame:
    """Small noisy counts to zero, as adaptive clustering wants them."""
    cut = eta * float(np.log(n)) / (eps * ratio)
    return x.select("cell", F.when(F.col("value") <= cut, 0.0).otherwise(F.col("value")).alias("value"))


# Errors


def per_query_error(workload: Matrix | np.ndarray, strategy: Matrix | np.ndarray, eps: float) -> np.ndarray:
    """The expected squared error of each query under a strategy's least squares."""
    w, a = as_matrix(workload).numpy(), as_matrix(strategy)
    return 2 / eps**2 * a.sensitivity() ** 2 * np.einsum("ij,ij->i", w @ np.linalg.pinv(a.gram()), w)


def expected_error(workload: Matrix | np.ndarray, strategy: Matrix | np.ndarray, eps: float) -> float:
    w, a = as_matrix(workload), as_matrix(strategy)
    return float(2 / eps**2 * a.sensitivity() ** 2 * np.sum(w.gram() * np.linalg.pinv(a.gram())))


def root_mean_error(workload: Matrix | np.ndarray, strategy: Matrix | np.ndarray, eps: float) -> float:
    return math.sqrt(expected_error(workload, strategy, eps) / as_matrix(workload).m)


def squared_error(workload: Matrix | np.ndarray, truth: np.ndarray, estimate: np.ndarray) -> float:
    return float(np.sum(as_matrix(workload).times(np.asarray(truth, float) - estimate) ** 2))


def average_error(workload: Matrix | np.ndarray, truth: np.ndarray, estimates: list[np.ndarray]) -> tuple[float, float]:
    """The mean squared error a query over trials, and the half width of its 95 % interval."""
    w = as_matrix(workload)
    each = np.array([squared_error(w, truth, e) / w.m for e in estimates])
    return float(each.mean()), float(1.96 * each.std() / math.sqrt(len(each)))


def errors(truth: DataFrame, estimate: DataFrame) -> DataFrame:
    """Of answers (query, value): the root of the mean square, the mean and the largest absolute difference; one row."""
    gap = truth.alias("t").join(estimate.alias("e"), "query").select((F.col("t.value") - F.col("e.value")).alias("gap"))
    return gap.agg(F.sqrt(F.avg(F.col("gap") * F.col("gap"))).alias("root_mean_square"), F.avg(F.abs("gap")).alias("mean"), F.max(F.abs("gap")).alias("largest"))

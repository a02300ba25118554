"""Noise as column expressions of a seed and a row key: the same under any partitioning and in any SQL engine.

In production the seed is drawn from `secrets` for each measurement; repeating a seed repeats its noise. The seed is a
literal of the query's plan, so event logs and the web interface hold what is needed to subtract the noise: on a cluster that
answers to people outside, they must be as closed as the table itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT = 4503599627370496.0  # 2 ** 52, for 13 hex digits


def uniform(seed: str, key: Column) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / _UNIT


def laplace(seed: str, key: Column, scale: float | Column) -> Column:
    u = uniform(seed, key) - 0.5
    return -(F.lit(scale) if not isinstance(scale, Column) else scale) * F.signum(u) * F.ln(1 - 2 * F.abs(u))


def discrete_laplace(seed: str, key: Column, scale: float) -> Column:
    """Difference of two geometric draws: integers, free of the floating-point leak of the continuous law."""
    draw = lambda s: F.floor(F.ln(uniform(f"{seed}/{s}", key)) * (-scale))
    return draw("a") - draw("b")


def gumbel(seed: str, key: Column) -> Column:
    return -F.ln(-F.ln(uniform(seed, key)))


def exponential(seed: str, key: Column, scale: float) -> Column:
    return -scale * F.ln(uniform(seed, key))


def geometric(seed: str, key: Column, p: float) -> Column:
    """Failures before the first success."""
    return F.floor(F.ln(uniform(seed, key)) / math.log1p(-p))


def gaussian(seed: str, key: Column, deviation: float) -> Column:
    """By the polar form of two uniform draws."""
    return deviation * F.sqrt(-2 * F.ln(uniform(f"{seed}/r", key))) * F.cos(2 * math.pi * uniform(f"{seed}/a", key))


def cauchy(seed: str, key: Column, scale: float) -> Column:
    return scale * F.tan(math.pi * (uniform(seed, key) - 0.5))


def weighted_choice(seed: str, key: Column, weights: list[float]) -> Column:
    """An index drawn in proportion to its weight."""
    whole, done, out = sum(weights), 0.0, F.lit(0)
    for w in weights[:-1]:
        done += w
        out = out + F.when(uniform(seed, key) * whole >= done, 1).otherwise(0)
    return out

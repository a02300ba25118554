"""Histograms of streams: counts of a relation's cells by event-time window, for watermarked sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyveil.functions.binning import Attribute, cell


def windowed_histogram(stream: DataFrame, attributes: list[Attribute], time: str, window: str, late: str) -> DataFrame:
    """(window start, cell, value); works on streams and tables alike."""
    rows = stream.withWatermark(time, late).select(time, *[a.bin().alias(f"b{i}") for i, a in enumerate(attributes)])
    for i in range(len(attributes)):
        rows = rows.where(F.col(f"b{i}").isNotNull())
    at = cell([F.col(f"b{i}") for i in range(len(attributes))], tuple(a.bins for a in attributes))
    counts = rows.groupBy(F.window(time, window).alias("w"), at.alias("cell")).agg(F.count("*").alias("value"))
    return counts.select(F.col("w.start").alias("start"), "cell", "value")

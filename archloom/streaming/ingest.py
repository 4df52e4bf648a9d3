"""Captures as they come: a stream of rows with a key and an event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_in_window(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Later rows of a key within the watermark's reach are dropped. Across the reach the batch operator decides: a stream can't know a global first."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def status_counts(stream: DataFrame, time: str, status: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, status, n) of each window of time, once it is closed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), status).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), status, "n")

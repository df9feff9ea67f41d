"""Curve averaging and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def average_curve(
    curves: DataFrame, keys: Sequence[str], values: Sequence[str], time_column: str = "time_s"
) -> DataFrame:
    """Mean by time over the runs that have that time."""
    return curves.groupBy(*keys, time_column).agg(*[F.avg(v).alias(v) for v in values])


def curve_quality(curves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per curve: points, first time, distinct times and whether it may be reused.

    A reusable curve is not empty, never starts before zero and has one value
    per time. Times are counted after a grouping on them, so a long curve is
    not held in one place.
    """
    per_time = curves.groupBy(*keys, "time_s").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_time.groupBy(*keys)
        .agg(
            F.sum("n").alias("n_points"),
            F.min("time_s").alias("first_s"),
            F.count("time_s").alias("n_times"),
        )
        .withColumn(
            "valid",
            F.coalesce((F.col("first_s") >= 0) & (F.col("n_times") == F.col("n_points")), F.lit(False)),
        )
    )


def missing_segments(stats: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected (keys, segment) rows a stored latency table lacks."""
    return expected.join(stats.select(*keys, "segment"), [*keys, "segment"], "left_anti")

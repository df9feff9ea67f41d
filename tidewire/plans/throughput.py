"""Throughput curves: sliding windows over bytes per second."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.labels import series_label
from tidewire.operators.size_fill import recovered_sizes
from tidewire.plans.curves import average_curve
from tidewire.schemas import RUN, THROUGHPUT_TYPES
from tidewire.session import materialise

DEFAULT_WINDOW_S = 10
DEFAULT_TRIM_S = 5


def second_buckets(events: DataFrame, event_types: Sequence[str] | None = None) -> DataFrame:
    """Bytes per (run, event type, epoch second), sizes filled.

    Sizes are looked up for the named event types only; the others are still
    counted with the sizes they report and for the run start.

    Rows with their own size are summed where they are read; only rows that
    lack one go through the size lookup. ``first_ms`` is the earliest event of
    the bucket, sized or not, so the run start needs no second scan.
    """
    second = F.floor(F.unix_millis("timestamp") / 1000).cast("bigint").alias("second")
    known = events.groupBy(*RUN, "event_type", second).agg(
        F.sum("serialized_size").alias("bytes"),
        F.count("serialized_size").alias("sized"),
        F.unix_millis(F.min("timestamp")).alias("first_ms"),
    )
    found = (
        recovered_sizes(events, event_types)
        .filter(F.col("serialized_size").isNotNull())
        .groupBy(*RUN, "event_type", second)
        .agg(
            F.sum("serialized_size").alias("bytes"),
            F.count("serialized_size").alias("sized"),
            F.lit(None).cast("bigint").alias("first_ms"),
        )
    )
    return (
        known.unionByName(found)
        .groupBy(*RUN, "event_type", "second")
        .agg(
            F.sum("bytes").alias("bytes"),
            F.sum("sized").alias("sized"),
            F.min("first_ms").alias("first_ms"),
        )
    )


def curve_from_buckets(
    buckets: DataFrame, window_s: int, event_types: Sequence[str] = THROUGHPUT_TYPES
) -> DataFrame:
    """Windows of ``window_s`` seconds starting every second, from the run start on.

    The hop divides the width, so windows are summed from one-second buckets:
    ``seconds * window_s`` small rows instead of a copy of every event.
    """
    start = buckets.groupBy(*RUN).agg(F.min("first_ms").alias("start_ms"))
    windows = (
        buckets.filter(F.col("event_type").isin(*event_types))
        .filter((F.col("sized") > 0) & F.col("second").isNotNull())
        .select(
            *RUN,
            "event_type",
            "bytes",
            F.explode(F.sequence(F.col("second") - (window_s - 1), F.col("second"))).alias("at_s"),
        )
        .groupBy(*RUN, "event_type", "at_s")
        .agg(F.sum("bytes").alias("bytes"))
    )
    offset = F.floor((F.col("at_s") * 1000 - F.col("start_ms")) / 1000).cast("bigint")
    return (
        windows.join(start, RUN)
        .withColumn("time_s", offset)
        .filter(F.col("time_s") >= 0)
        .select(
            *RUN,
            "event_type",
            "time_s",
            (F.col("bytes").cast("double") / window_s / 1_000_000).alias("throughput_mb_s"),
        )
    )


def throughput(
    events: DataFrame,
    window_s: int = DEFAULT_WINDOW_S,
    event_types: Sequence[str] = THROUGHPUT_TYPES,
) -> DataFrame:
    """Throughput curve of every run and requested event type in one job."""
    buckets = materialise(second_buckets(events, event_types), "second-buckets")
    return curve_from_buckets(buckets, window_s, event_types)


def trim_throughput(
    curve: DataFrame,
    window_s: int = DEFAULT_WINDOW_S,
    start_s: int = DEFAULT_TRIM_S,
    end_s: int = DEFAULT_TRIM_S,
) -> DataFrame:
    """Drop the unstable edges; the tail loses at least one window width."""
    keys = [*RUN, "event_type"]
    tail = max(0, end_s, window_s)
    last = curve.groupBy(*keys).agg((F.max("time_s") - tail).alias("last_s"))
    return (
        curve.join(last, keys)
        .filter(F.col("time_s").between(F.lit(start_s), F.col("last_s")))
        .drop("last_s")
    )


def mean_throughput_table(trimmed: DataFrame) -> DataFrame:
    """Unweighted mean of the run means, rounded, best first per event type."""
    return (
        trimmed.groupBy(*RUN, "event_type")
        .agg(F.avg("throughput_mb_s").alias("run_mean"))
        .groupBy("scenario", "tech", "event_type")
        .agg(F.round(F.avg("run_mean"), 2).alias("mean_throughput_mb_s"))
        .orderBy("scenario", F.asc("event_type"), F.desc("mean_throughput_mb_s"))
    )


def throughput_display(trimmed: DataFrame, show_individual: bool = True) -> DataFrame:
    """The run average per technology and, on request, the single runs, labelled."""
    columns = ["scenario", "tech", "run", "event_type", "time_s", "throughput_mb_s"]
    shown = (
        average_curve(trimmed, ["scenario", "tech", "event_type"], ["throughput_mb_s"])
        .withColumn("run", F.lit("avg"))
        .select(*columns)
    )
    if show_individual:
        shown = shown.unionByName(trimmed.select(*columns))
    return shown.withColumn("series", series_label(F.col("tech"), F.col("run")))

"""Resource usage curves from cumulative counters and gauges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.labels import is_reported_source, series_label
from tidewire.functions.lenient import nonnegative
from tidewire.operators.sliced_window import SLICE_US, with_previous
from tidewire.plans.curves import average_curve
from tidewire.schemas import RESOURCE_METRICS, RUN
from tidewire.session import materialise

MIB = 1024 * 1024


def _rate(*counters: str) -> Column:
    """MB/s since the previous sample; first sample, no time and resets give 0."""
    change = sum((F.col(c) - F.col(f"prev_{c}") for c in counters[1:]),
                 F.col(counters[0]) - F.col(f"prev_{counters[0]}"))
    rate = F.when(F.col("seconds") > 0, change / F.col("seconds") / 1_000_000).otherwise(F.lit(0.0))
    return nonnegative(F.coalesce(rate, F.lit(0.0)))


def counter_rates(
    samples: DataFrame, tie: list[str] | None = None, slice_us: int = SLICE_US
) -> DataFrame:
    """Per sample: ordinal inside its source and the three derived rates."""
    reported = samples.filter(is_reported_source(F.col("source"))).withColumn(
        "us", F.unix_micros("timestamp")
    )
    counters = ["disk_read", "disk_write", "network_rx", "network_tx"]
    # Equal times are told apart by the counters when no other column does it.
    ties = tie if tie is not None else ["cpu_usage_ns", *counters]
    linked = with_previous(
        reported,
        [*RUN, "source"],
        "us",
        ties,
        ["us", *counters],
        ordinal="row_index",
        slice_us=slice_us,
    )
    ms = F.floor(F.col("us") / 1000)
    prev_ms = F.floor(F.col("prev_us") / 1000)
    return (
        linked.withColumn("seconds", (ms - prev_ms) / 1000)
        .withColumn("disk_throughput_mb_s", _rate("disk_read", "disk_write"))
        .withColumn("network_rx_mb_s", _rate("network_rx"))
        .withColumn("network_tx_mb_s", _rate("network_tx"))
        .drop("seconds", "us", "prev_us", *[f"prev_{c}" for c in counters])
    )


def resource_usage(
    samples: DataFrame, tie: list[str] | None = None, slice_us: int = SLICE_US
) -> DataFrame:
    """Producer and broker samples summed by ordinal, one curve per run.

    The curve ends at the shortest producer; a run without producers has none.
    Ordinals are dense in every source, so an ordinal lies within the shortest
    producer exactly when as many producers have it as have the first one.
    """
    rates = counter_rates(samples, tie, slice_us)
    # Partial sums per (run, ordinal) before anything is joined.
    summed = rates.groupBy(*RUN, "row_index").agg(
        F.floor(F.avg(F.unix_millis("timestamp"))).cast("bigint").alias("at_ms"),
        F.count(F.when(F.col("source").startswith("P"), 1)).alias("producers"),
        F.sum("cpu_usage_perc").alias("cpu_usage_perc"),
        (F.sum("memory_usage") / MIB).alias("memory_mb"),
        (F.sum("page_cache") / MIB).alias("page_cache_mb"),
        F.sum("disk_throughput_mb_s").alias("disk_throughput_mb_s"),
        F.sum("network_rx_mb_s").alias("network_rx_mb_s"),
        F.sum("network_tx_mb_s").alias("network_tx_mb_s"),
    )
    summed = materialise(summed, "resource-ordinals")
    every = summed.groupBy(*RUN).agg(F.max("producers").alias("all_producers"))
    kept = summed.join(every, RUN).filter(
        (F.col("all_producers") > 0) & (F.col("producers") == F.col("all_producers"))
    )
    origin = kept.groupBy(*RUN).agg(F.min("at_ms").alias("origin_ms"))
    offset = F.floor((F.col("at_ms") - F.col("origin_ms")) / 1000).cast("bigint")
    return kept.join(origin, RUN).select(*RUN, offset.alias("time_s"), *RESOURCE_METRICS)


def resource_display(usage: DataFrame, show_individual: bool = True) -> DataFrame:
    """Long form of the six metrics: run average and, on request, single runs."""
    average = average_curve(usage, ["scenario", "tech"], RESOURCE_METRICS).withColumn(
        "run", F.lit("avg")
    )
    shown = average.select(*RUN, "time_s", *RESOURCE_METRICS)
    if show_individual:
        shown = shown.unionByName(usage.select(*RUN, "time_s", *RESOURCE_METRICS))
    return shown.unpivot(
        [*RUN, "time_s"], RESOURCE_METRICS, "metric", "value"
    ).withColumn("series", series_label(F.col("tech"), F.col("run")))

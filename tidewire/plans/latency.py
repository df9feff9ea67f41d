"""Latency segments: exact nearest-rank percentiles per run and segment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.rank_select import histogram_quantiles
from tidewire.operators.stage_pairs import (
    message_stages,
    settle_end_to_end,
    stage_bounds,
    weighted_pairs,
)
from tidewire.schemas import DESERIALIZED, END_TO_END, PUB_TO_REC, REC_TO_DES, RUN, SER_TO_PUB
from tidewire.session import materialise, small_tasks

# The reported percentiles.
QUANTILES = {"p50_ms": 0.50, "p90_ms": 0.90, "p99_ms": 0.99}
STATS = [*QUANTILES, "max_ms"]
_KEYS = [*RUN, "segment"]


def expected_segments(bounds: DataFrame) -> DataFrame:
    """The segments each run must report."""
    always = [F.lit(s) for s in (SER_TO_PUB, PUB_TO_REC, END_TO_END)]
    segments = F.when(
        F.col("has_deserialized"), F.array(*always, F.lit(REC_TO_DES))
    ).otherwise(F.array(*always))
    return bounds.select(*RUN, F.explode(segments).alias("segment"))


def _stats(hist: DataFrame) -> DataFrame:
    return histogram_quantiles(hist, _KEYS, "latency_ms", "weight", QUANTILES, "max_ms")


def latency_stats(events: DataFrame) -> DataFrame:
    """Percentiles per run and segment; a segment without samples gives nulls."""
    with small_tasks(events.sparkSession):
        stages = materialise(message_stages(events), "message-stages")
        bounds = materialise(stage_bounds(stages), "run-bounds")
        hist = (
            weighted_pairs(events, stages)
            .groupBy(*RUN, "segment", "latency_ms")
            .agg(F.sum("weight").alias("weight"))
        )
        hist = materialise(settle_end_to_end(hist, bounds), "latency-histogram")
    return expected_segments(bounds).join(_stats(hist), _KEYS, "left")


def segment_samples(events: DataFrame) -> DataFrame:
    """Samples as (segment, start second of the run, latency) with their count, written once."""
    with small_tasks(events.sparkSession):
        stages = materialise(message_stages(events), "message-stages")
        # Written first, so its size is known and the join below needs no shuffle
        # of the pairs by run unless there are very many runs.
        bounds = materialise(stage_bounds(stages), "run-bounds")
        timed = (
            weighted_pairs(events, stages)
            .join(bounds.select(*RUN, "start_ms"), RUN)
            .withColumn(
                "time_s", F.floor((F.col("t0_ms") - F.col("start_ms")) / 1000).cast("bigint")
            )
            .groupBy(*RUN, "segment", "time_s", "latency_ms")
            .agg(F.sum("weight").alias("weight"))
        )
        return materialise(settle_end_to_end(timed, bounds), "segment-samples")


def latency_trimmed(events: DataFrame, start_s: int = 5, end_s: int = 5) -> DataFrame:
    """Percentiles without the first and last seconds of each run.

    The end is taken from the latest start over all segments of the run. A
    segment left without samples gives no row; with both offsets zero this is
    ``latency_stats``.
    """
    if start_s == 0 and end_s == 0:
        return latency_stats(events)
    return trimmed_from_samples(segment_samples(events), start_s, end_s)


def trimmed_from_samples(samples: DataFrame, start_s: int = 5, end_s: int = 5) -> DataFrame:
    """``latency_trimmed`` of samples that were counted, and written, before."""
    last = materialise(
        samples.groupBy(*RUN).agg((F.max("time_s") - end_s).alias("last_s")), "run-ends"
    )
    hist = (
        samples.join(last, RUN)
        .filter(F.col("time_s").between(F.lit(start_s), F.col("last_s")))
        .groupBy(*RUN, "segment", "latency_ms")
        .agg(F.sum("weight").alias("weight"))
    )
    return _stats(hist)


def stored_samples(events: DataFrame) -> DataFrame:
    """What the metric store keeps of a run: its samples and, with weight 0, the segments it must report.

    Weights add up, so percentiles at any offsets, and over several runs, come from these rows.
    """
    samples = segment_samples(events)
    bounds = events.groupBy(*RUN).agg(F.max(F.col("event_type") == DESERIALIZED).alias("has_deserialized"))
    nothing = [F.lit(v).cast("bigint").alias(c) for c, v in (("time_s", None), ("latency_ms", None), ("weight", 0))]
    return samples.unionByName(expected_segments(bounds).select(*_KEYS, *nothing))


def latency_from_store(stored: DataFrame, start_s: int = 5, end_s: int = 5) -> DataFrame:
    """``latency_trimmed`` of ``stored_samples``; without offsets all expected segments have a row."""
    samples = stored.filter("weight > 0")
    if start_s or end_s:
        return trimmed_from_samples(samples, start_s, end_s)
    hist = samples.groupBy(*_KEYS, "latency_ms").agg(F.sum("weight").alias("weight"))
    expected = stored.filter("weight = 0").select(*_KEYS)
    return expected.join(_stats(materialise(hist, "latency-histogram")), _KEYS, "left")


def average_latency(stats: DataFrame) -> DataFrame:
    """Mean of the per-run percentiles by segment."""
    return stats.groupBy("scenario", "tech", "segment").agg(*[F.avg(c).alias(c) for c in STATS])


def latency_table(average: DataFrame) -> DataFrame:
    """Display names, two decimals, slowest first inside each segment."""
    shown = [
        F.round(F.col(c), 2).alias(name)
        for c, name in zip(STATS, ["P50", "P90", "P99", "Max"])
    ]
    return average.select("scenario", F.col("tech").alias("tech_name"), "segment", *shown).orderBy(
        "scenario", F.asc("segment"), F.desc("P99")
    )

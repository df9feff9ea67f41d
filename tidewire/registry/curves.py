"""Throughput, latency and run queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.size_fill import fill_sizes
from tidewire.plans import latency as lat
from tidewire.plans import throughput as thr
from tidewire.plans.curves import average_curve, curve_quality, missing_segments
from tidewire.plans.runs import run_bounds
from tidewire.registry import register
from tidewire.registry import sql_views as sql
from tidewire.registry.events import events
from tidewire.schemas import RUN


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if c in columns else F.col(c) for c in df.columns])


@register(
    "event_log_scan",
    sql.with_views(
        sql.EVENTS,
        """SELECT scenario, tech, run, container_name, us, event_type, message_id,
                  logical_size, topic, serialized_size FROM ev""",
    ),
)
def event_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = events(spark, sf_dir, text_time=True)
    return scanned.withColumn("us", F.unix_micros("timestamp")).drop("timestamp")


@register(
    "size_fill",
    sql.with_views(
        sql.FILLED,
        """SELECT scenario, tech, run, message_id, topic, event_type, container_name, us,
                  serialized_size FROM filled""",
    ),
)
def size_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_sizes(events(spark, sf_dir)).select(
        *RUN,
        "message_id",
        "topic",
        "event_type",
        "container_name",
        F.unix_micros("timestamp").alias("us"),
        "serialized_size",
    )


@register("run_bounds", sql.with_views(sql.SAMPLES, "SELECT * FROM bounds"))
def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_bounds(events(spark, sf_dir))


@register(
    "throughput",
    sql.with_views(
        sql.curve(10),
        """SELECT scenario, tech, run, event_type, time_s,
                  round(throughput_mb_s, 9) AS throughput_mb_s FROM curve""",
    ),
)
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(thr.throughput(events(spark, sf_dir)), "throughput_mb_s")


@register(
    "throughput_narrow_window",
    sql.with_views(
        sql.curve(1),
        """SELECT scenario, tech, run, event_type, time_s,
                  round(throughput_mb_s, 9) AS throughput_mb_s FROM curve""",
    ),
)
def throughput_narrow_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(thr.throughput(events(spark, sf_dir), window_s=1), "throughput_mb_s")


def _trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thr.trim_throughput(thr.throughput(events(spark, sf_dir)))


@register(
    "throughput_trimmed",
    sql.with_views(
        sql.trimmed_curve(),
        """SELECT scenario, tech, run, event_type, time_s,
                  round(throughput_mb_s, 9) AS throughput_mb_s FROM trimmed""",
    ),
)
def throughput_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_trimmed(spark, sf_dir), "throughput_mb_s")


@register(
    "average_curve",
    sql.with_views(
        sql.trimmed_curve(),
        """SELECT scenario, tech, event_type, time_s,
                  round(avg(throughput_mb_s), 9) AS throughput_mb_s
           FROM trimmed GROUP BY ALL""",
    ),
)
def averaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = average_curve(
        _trimmed(spark, sf_dir), ["scenario", "tech", "event_type"], ["throughput_mb_s"]
    )
    return _rounded(mean, "throughput_mb_s").orderBy("scenario", "tech", "event_type", "time_s")


@register(
    "mean_throughput_table",
    sql.with_views(
        sql.trimmed_curve(),
        """SELECT scenario, tech, event_type, round(avg(m), 2) AS mean_throughput_mb_s FROM (
             SELECT scenario, tech, run, event_type, avg(throughput_mb_s) AS m
             FROM trimmed GROUP BY ALL) GROUP BY ALL""",
    ),
)
def mean_throughput_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thr.mean_throughput_table(_trimmed(spark, sf_dir))


@register(
    "throughput_display",
    sql.with_views(
        sql.trimmed_curve(),
        """SELECT scenario, tech, 'avg' AS run, event_type, time_s,
                  round(avg(throughput_mb_s), 9) AS throughput_mb_s, tech || ' (avg)' AS series
           FROM trimmed GROUP BY scenario, tech, event_type, time_s
           UNION ALL
           SELECT scenario, tech, run, event_type, time_s, round(throughput_mb_s, 9),
                  tech || ' (' || run || ')' FROM trimmed""",
    ),
)
def throughput_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(thr.throughput_display(_trimmed(spark, sf_dir)), "throughput_mb_s")


@register(
    "segment_samples",
    sql.with_views(
        sql.SAMPLES,
        """SELECT scenario, tech, run, segment, time_s, latency_ms, count(*) AS weight
           FROM samples GROUP BY ALL""",
    ),
)
def segment_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lat.segment_samples(events(spark, sf_dir))


@register("latency_stats", sql.with_views(sql.LATENCY_STATS, "SELECT * FROM latency_stats"))
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lat.latency_stats(events(spark, sf_dir))


@register("latency_trimmed", sql.with_views(sql.LATENCY_TRIMMED, "SELECT * FROM stats"))
def latency_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lat.latency_trimmed(events(spark, sf_dir), 5, 5)


@register(
    "average_latency",
    sql.with_views(
        sql.LATENCY_TRIMMED,
        """SELECT scenario, tech, segment, round(avg(p50_ms), 9) AS p50_ms,
                  round(avg(p90_ms), 9) AS p90_ms, round(avg(p99_ms), 9) AS p99_ms,
                  round(avg(max_ms), 9) AS max_ms
           FROM stats GROUP BY ALL""",
    ),
)
def average_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = lat.average_latency(lat.latency_trimmed(events(spark, sf_dir), 5, 5))
    return _rounded(mean, *lat.STATS)


@register(
    "latency_table",
    sql.with_views(
        sql.LATENCY_TRIMMED,
        """SELECT scenario, tech AS tech_name, segment, round(avg(p50_ms), 2) AS P50,
                  round(avg(p90_ms), 2) AS P90, round(avg(p99_ms), 2) AS P99,
                  round(avg(max_ms), 2) AS "Max"
           FROM stats GROUP BY scenario, tech, segment""",
    ),
)
def latency_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    trimmed = lat.latency_trimmed(events(spark, sf_dir), 5, 5)
    return lat.latency_table(lat.average_latency(trimmed))


@register(
    "curve_quality_check",
    sql.with_views(
        sql.curve(10),
        """SELECT scenario, tech, run, event_type, count(*) AS n_points, min(time_s) AS first_s,
                  count(DISTINCT time_s) AS n_times,
                  min(time_s) >= 0 AND count(DISTINCT time_s) = count(*) AS valid
           FROM curve GROUP BY ALL""",
    ),
)
def curve_quality_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_quality(thr.throughput(events(spark, sf_dir)), [*RUN, "event_type"])


@register(
    "latency_quality_check",
    sql.with_views(
        sql.LATENCY_STATS
        + """,
seen AS (SELECT DISTINCT scenario, tech, run, segment FROM samples WHERE latency_ms >= 100)""",
        """SELECT e.scenario, e.tech, e.run, e.segment FROM expected e
           ANTI JOIN seen USING (scenario, tech, run, segment)""",
    ),
)
def latency_quality_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments a table cut down to slow samples no longer covers."""
    log = events(spark, sf_dir)
    slow = lat.segment_samples(log).filter("latency_ms >= 100").select(*RUN, "segment").distinct()
    return missing_segments(slow, lat.expected_segments(run_bounds(log)), RUN)

"""Round trips through the sinks and the metric store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.plans import store
from tidewire.plans.curves import curve_quality
from tidewire.plans.resources import resource_usage
from tidewire.plans.throughput import throughput
from tidewire.registry import register
from tidewire.registry import sql_views as sql
from tidewire.registry.events import events
from tidewire.registry.resources import _METRICS, samples
from tidewire.schemas import RESOURCE_COUNTERS, RESOURCE_METRICS, RUN
from tidewire.session import materialise, scratch_path
from tidewire.sources.event_log import read_event_log, write_event_log
from tidewire.sources.resources import read_samples, write_samples


@register(
    "event_log_roundtrip",
    sql.with_views(
        sql.EVENTS,
        """SELECT scenario, tech, run, container_name, us, event_type, message_id,
                  logical_size, topic, serialized_size FROM ev""",
    ),
)
def event_log_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "event-log")
    write_event_log(events(spark, sf_dir), path)
    back = read_event_log(spark, path)
    return back.withColumn("us", F.unix_micros("timestamp")).drop("timestamp")


@register(
    "resource_roundtrip",
    sql.with_views(
        sql.RESOURCES,
        f"""SELECT scenario, tech, run, source, us, {", ".join(RESOURCE_COUNTERS)}
            FROM res""",
    ),
)
def resource_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "resource-samples")
    write_samples(samples(spark, sf_dir), path)
    back = read_samples(spark, path)
    return back.withColumn("us", F.unix_micros("timestamp")).drop("timestamp")


_CURVE_SCHEMA = (
    "time_s bigint, throughput_mb_s double, scenario string, tech string, run string, event string"
)


@register(
    "metric_store_roundtrip",
    sql.with_views(
        sql.curve(10),
        """SELECT scenario, tech, run, lower(event_type) AS event, time_s,
                  round(throughput_mb_s, 9) AS throughput_mb_s FROM curve""",
    ),
)
def metric_store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the runs are stored first; the rest is computed on the second read."""
    log = events(spark, sf_dir)
    path = store.metric_path(scratch_path(spark, "metrics"), "throughput", window_s=10)

    def compute(missing: DataFrame) -> DataFrame:
        wanted = log.join(missing, RUN, "left_semi")
        return store.with_event_label(throughput(wanted))

    def valid(stored: DataFrame) -> DataFrame:
        checked = curve_quality(stored, [*RUN, "event"])
        return checked.groupBy(*RUN).agg(F.bool_and("valid").alias("ok")).filter("ok").select(*RUN)

    keys = [*RUN, "event"]
    runs = log.select(*RUN).distinct()
    some = runs.filter(F.col("run") == "r0")
    store.load_or_compute(spark, path, _CURVE_SCHEMA, some, compute, keys, valid)
    full = store.load_or_compute(spark, path, _CURVE_SCHEMA, runs, compute, keys, valid)
    return full.withColumn("throughput_mb_s", F.round("throughput_mb_s", 9))


@register(
    "resource_store_roundtrip",
    sql.with_views(sql.USAGE, f"SELECT scenario, tech, run, time_s, {_METRICS} FROM usage"),
)
def resource_store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of some runs is stored from other inputs first and replaced when their marks change."""
    rows = samples(spark, sf_dir)
    path = store.metric_path(scratch_path(spark, "metrics"), "resources")
    schema = f"time_s bigint, {', '.join(f'{m} double' for m in RESOURCE_METRICS)}, scenario string, tech string, run string"
    runs = rows.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("event_id").alias("n_bytes"), F.max(F.unix_micros("timestamp")).alias("changed_us")
    )
    runs = materialise(runs, "marks")

    def usage_of(log: DataFrame):
        def compute(missing: DataFrame) -> DataFrame:
            usage = resource_usage(log.join(missing, RUN, "left_semi"), ["event_id"])
            return usage.select("time_s", *RESOURCE_METRICS, *RUN)

        return compute

    def valid(stored: DataFrame) -> DataFrame:
        return stored.groupBy(*RUN).agg(F.min("time_s").alias("first_s")).filter("first_s >= 0").select(*RUN)

    first = runs.filter("run = 'r0'").withColumn("n_files", F.col("n_files") - F.when(F.col("tech") == "beta", 1).otherwise(0))
    fewer = rows.filter("tech = 'alpha' OR event_id % 3 = 0")
    store.load_or_compute(spark, path, schema, first, usage_of(fewer), RUN, valid, first)
    full = store.load_or_compute(spark, path, schema, runs, usage_of(rows), RUN, valid, runs)
    return full.select(*RUN, "time_s", *[F.round(m, 6).alias(m) for m in RESOURCE_METRICS])

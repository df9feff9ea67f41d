"""Resource sample queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.labels import source_label
from tidewire.plans import resources as res
from tidewire.registry import register
from tidewire.registry import sql_views as sql
from tidewire.registry.tables import resource_rows
from tidewire.schemas import RESOURCE_COUNTERS, RESOURCE_METRICS, RUN
from tidewire.sources.resources import normalise_samples

_METRICS = ", ".join(f"round({m}, 6) AS {m}" for m in RESOURCE_METRICS)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = resource_rows(spark, sf_dir)
    stem = F.concat(F.lit("demo_"), F.col("container"))
    return normalise_samples(raw, stem, extra=["event_id"])


@register(
    "resource_scan",
    sql.with_views(
        sql.RESOURCES,
        f"""SELECT scenario, tech, run, event_id, source, us, {", ".join(RESOURCE_COUNTERS)}
            FROM res""",
    ),
)
def resource_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).withColumn("us", F.unix_micros("timestamp")).drop("timestamp")


@register(
    "source_label",
    """SELECT tech, source, count(*) AS n FROM (
         SELECT CASE WHEN user_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS tech,
                CASE (user_id // 4) % 5 WHEN 0 THEN 'P0' WHEN 1 THEN 'P1' WHEN 2 THEN 'Broker'
                  WHEN 3 THEN 'C0' ELSE 'P2' END AS source
         FROM events) GROUP BY ALL""",
)
def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.concat(F.lit("demo_"), F.col("container"))
    return (
        resource_rows(spark, sf_dir)
        .select("tech", source_label(stem).alias("source"))
        .groupBy("tech", "source")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@register(
    "counter_rates",
    sql.with_views(
        sql.RATES,
        """SELECT scenario, tech, run, source, event_id, row_index,
                  round(CAST(disk_throughput_mb_s AS DOUBLE), 6) AS disk_throughput_mb_s,
                  round(CAST(network_rx_mb_s AS DOUBLE), 6) AS network_rx_mb_s,
                  round(CAST(network_tx_mb_s AS DOUBLE), 6) AS network_tx_mb_s
           FROM rates""",
    ),
)
def counter_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = res.counter_rates(samples(spark, sf_dir), ["event_id"])
    return rates.select(
        *RUN,
        "source",
        "event_id",
        "row_index",
        *[F.round(c, 6).alias(c) for c in RESOURCE_METRICS[3:]],
    )


@register(
    "resource_usage",
    sql.with_views(sql.USAGE, f"SELECT scenario, tech, run, time_s, {_METRICS} FROM usage"),
)
def resource_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = res.resource_usage(samples(spark, sf_dir), ["event_id"])
    return usage.select(*RUN, "time_s", *[F.round(m, 6).alias(m) for m in RESOURCE_METRICS])


@register(
    "resource_display",
    sql.with_views(
        sql.USAGE
        + """,
means AS (
  SELECT scenario, tech, time_s, """
        + ", ".join(f"avg({m}) AS {m}" for m in RESOURCE_METRICS)
        + """ FROM usage GROUP BY ALL),
wide AS (
  SELECT scenario, tech, 'avg' AS run, time_s, """
        + ", ".join(RESOURCE_METRICS)
        + """ FROM means
  UNION ALL
  SELECT scenario, tech, run, time_s, """
        + ", ".join(RESOURCE_METRICS)
        + """ FROM usage),
long AS (UNPIVOT wide ON """
        + ", ".join(RESOURCE_METRICS)
        + " INTO NAME metric VALUE value)",
        """SELECT scenario, tech, run, time_s, metric, round(value, 6) AS value,
                  tech || ' (' || run || ')' AS series FROM long""",
    ),
)
def resource_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = res.resource_usage(samples(spark, sf_dir), ["event_id"])
    return res.resource_display(usage).withColumn("value", F.round("value", 6))

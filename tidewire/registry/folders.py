"""Run folders as the readers meet them: several runs, types and header orders at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.plans.latency import latency_from_store, segment_samples
from tidewire.plans.report import (
    Selection,
    ingest_run_folders,
    latency_samples,
    throughput_curves,
)
from tidewire.registry import register
from tidewire.registry import sql_views as sql
from tidewire.registry.ingest import log_lines
from tidewire.registry.tables import event_rows, resource_rows
from tidewire.schemas import RESOURCE_COUNTERS, RUN
from tidewire.session import scratch_path
from tidewire.sources.event_log import normalise_events, read_event_log, read_run_directories
from tidewire.sources.logs import parse_study_lines, read_run_logs
from tidewire.sources.resources import read_resource_files

_EVENTS = ["timestamp", "event_type", "message_id", "logical_size", "topic", "container_name"]
_RUNS = [("alpha", "r0"), ("alpha", "r1"), ("beta", "r0"), ("beta", "r1")]


def _folder(base: str, tech: str, run: str) -> str:
    return f"{base}/logs/demo/{tech}/{run}"


def _of(df: DataFrame, tech: str, run: str) -> DataFrame:
    return df.filter((F.col("tech") == tech) & (F.col("run") == run))


@register(
    "event_folders_scan",
    sql.with_views(
        sql.EVENTS,
        """SELECT 'logs' AS logs_root, scenario, tech, run, container_name, us, event_type,
                  message_id, CASE WHEN run = 'r1' AND tech = 'beta' THEN NULL ELSE logical_size END
                  AS logical_size, topic, serialized_size FROM ev""",
    ),
)
def event_folders_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text times, timestamps, double, decimal and text sizes, and a missing column side by side, also in a run."""
    base = scratch_path(spark, "event-folders")
    size = F.col("serialized_size")
    shapes = [
        (True, [*_EVENTS, size]),
        (False, [*_EVENTS, size.cast("int").alias("serialized_size")]),
        (False, [*_EVENTS, size.cast("double").alias("serialized_size")]),
        (True, [c for c in _EVENTS if c != "logical_size"] + [size.cast("string").alias("serialized_size")]),
    ]
    for (tech, run), (as_text, columns) in zip(_RUNS, shapes):
        rows = _of(event_rows(spark, sf_dir, as_text), tech, run)
        rows.filter("event_id % 3 > 0").select(*columns).write.parquet(_folder(base, tech, run))
        # A third of every run lies in files of another shape.
        rest = _of(event_rows(spark, sf_dir, not as_text), tech, run).filter("event_id % 3 = 0")
        others = [c for c in columns if isinstance(c, str)] + [size.cast("decimal(18,0)").alias("serialized_size")]
        rest.select(*others).write.mode("append").parquet(_folder(base, tech, run))
    back = read_run_directories(spark, base)
    return back.withColumn("us", F.unix_micros("timestamp")).drop("timestamp")


@register(
    "resource_folders_scan",
    sql.with_views(
        sql.RESOURCES,
        f"""SELECT 'logs' AS logs_root, scenario, tech, run, us,
                   {", ".join(c for c in RESOURCE_COUNTERS if c != "disk_write")},
                   CASE WHEN run = 'r1' AND tech = 'beta' THEN 0 ELSE disk_write END AS disk_write
            FROM res""",
    ),
)
def resource_folders_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header orders, quoting and a missing column side by side."""
    base = scratch_path(spark, "resource-folders")
    time = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")
    shapes = [
        ([time, *RESOURCE_COUNTERS], False),
        ([*RESOURCE_COUNTERS[::-1], time], False),
        ([*RESOURCE_COUNTERS[2:], time, *RESOURCE_COUNTERS[:2]], True),
        ([time, *[c for c in RESOURCE_COUNTERS if c != "disk_write"]], True),
    ]
    for (tech, run), (columns, quoted) in zip(_RUNS, shapes):
        rows = _of(resource_rows(spark, sf_dir), tech, run).select(*columns)
        # All cells as text, so that the writer quotes them where it is told to.
        text = rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns])
        text.write.option("header", True).option("quoteAll", quoted).csv(_folder(base, tech, run))
    back = read_resource_files(spark, base).drop("source")
    return back.withColumn("us", F.unix_micros("timestamp")).drop("timestamp")


@register(
    "log_folders_parse",
    sql.with_views(
        sql.MSG_EVENTS
        + """,
texts AS (
  SELECT *, strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S.%f') AS timestamp FROM msg_events)""",
        """SELECT 'logs' AS logs_root, scenario, tech, run, timestamp, event_type, message_id,
                  logical_size, topic, serialized_size FROM texts
           UNION ALL
           SELECT 'logs', scenario, tech, run, timestamp, 'Reception', message_id,
                  unnest([12, 7]), topic, unnest([NULL, 1000])
           FROM texts WHERE event_type = 'Serializing' AND event_id % 50 = 0""",
    ),
)
def log_folders_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw logs of all runs in one job, the run keys taken from their folders."""
    base = scratch_path(spark, "log-folders")
    for tech, run in _RUNS:
        lines = _of(log_lines(spark, sf_dir), tech, run).select("line")
        # The reader takes ``*.log``; Spark's text writer names its files ``*.txt``.
        lines.write.text(_folder(base, tech, run))
    return parse_study_lines(read_run_logs(spark, base, suffix="txt"), ["logs_root", *RUN])


@register(
    "ingest_runs",
    sql.with_views(
        sql.EVENTS,
        """SELECT scenario, tech, run, us, event_type, message_id, logical_size, topic,
                  serialized_size FROM ev
           UNION ALL
           SELECT scenario, tech, run, us, 'Reception', message_id, unnest([12, 7]), topic,
                  unnest([NULL, 1000])
           FROM ev WHERE event_type = 'Serializing' AND event_id % 50 = 0""",
    ),
)
def ingest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw logs of all runs to the partitioned event log in one job, and back."""
    base, out = scratch_path(spark, "raw-runs"), scratch_path(spark, "ingested")
    for tech, run in _RUNS:
        _of(log_lines(spark, sf_dir), tech, run).select("line").write.text(_folder(base, tech, run))
    ingest_run_folders(spark, base, out, "txt")
    back = read_event_log(spark, out).drop("container_name")
    return back.withColumn("us", F.unix_micros("timestamp")).drop("timestamp")


@register(
    "throughput_from_store",
    sql.with_views(
        sql.curve(10),
        """SELECT scenario, tech, run, lower(event_type) AS event, time_s,
                  round(throughput_mb_s, 9) AS throughput_mb_s FROM curve
           WHERE tech = 'beta' OR (run = 'r1' AND event_type = 'Publication')""",
    ),
)
def throughput_from_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between two reads one run gains rows, one loses its last stages and one all it can show.

    The fourth is read as it was stored.
    """
    base, root = scratch_path(spark, "store-runs"), scratch_path(spark, "store")
    rows = event_rows(spark, sf_dir).select("tech", "run", *_EVENTS, "serialized_size")

    def put(tech: str, run: str, keep: str = "true") -> None:
        mine = _of(rows, tech, run).drop("tech", "run").filter(keep)
        mine.write.mode("overwrite").parquet(_folder(base, tech, run))

    for tech, run in _RUNS:
        put(tech, run, "message_id like '%7'" if (tech, run) == ("beta", "r1") else "true")
    wanted = Selection("demo")
    throughput_curves(spark, base, wanted, root)
    put("beta", "r1")
    put("alpha", "r1", "event_type <> 'Deserialized'")
    put("alpha", "r0", "event_type = 'Serializing'")
    curve = throughput_curves(spark, base, wanted, root)
    return curve.withColumn("throughput_mb_s", F.round("throughput_mb_s", 9))


@register("latency_store_roundtrip", sql.with_views(sql.LATENCY_TRIMMED, "SELECT * FROM stats"))
def latency_store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run gains a file, another loses one, between two reads of the stored samples."""
    base, root = scratch_path(spark, "store-runs"), scratch_path(spark, "store")
    rows = event_rows(spark, sf_dir).select("event_id", "tech", "run", *_EVENTS, "serialized_size")

    def put(tech: str, run: str, keep: str, mode: str) -> None:
        mine = _of(rows, tech, run).filter(keep).drop("event_id", "tech", "run")
        mine.write.mode(mode).parquet(_folder(base, tech, run))

    for tech, run in _RUNS:
        put(tech, run, "event_id % 2 = 0" if (tech, run) == ("beta", "r1") else "true", "overwrite")
    # Copies of some rows, with more samples each.
    put("alpha", "r0", "event_id % 5 = 0", "append")
    wanted = Selection("demo")
    latency_samples(spark, base, wanted, root)
    put("beta", "r1", "event_id % 2 = 1", "append")
    put("alpha", "r0", "true", "overwrite")
    return latency_from_store(latency_samples(spark, base, wanted, root))


@register(
    "latency_redelivered",
    sql.with_views(
        sql.EVENTS
        + """,
logged AS (
  SELECT * REPLACE (CASE WHEN event_id % 41 = 0 THEN NULL ELSE topic END AS topic) FROM ev
  UNION ALL
  SELECT * FROM ev WHERE event_id % 7 = 0
  UNION ALL
  SELECT * REPLACE (us + 250000 AS us) FROM ev WHERE event_id % 11 = 0 AND event_type IN ('Reception', 'Deserialized'))"""
        + sql.SAMPLES.removeprefix(sql.EVENTS).replace("FROM ev ", "FROM logged ").replace("JOIN ev ", "JOIN logged "),
        """SELECT scenario, tech, run, segment, time_s, latency_ms, count(*) AS weight
           FROM samples GROUP BY ALL""",
    ),
)
def latency_redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies, messages received again later, and rows that lost their topic."""
    rows = event_rows(spark, sf_dir)
    lost = F.when(F.col("event_id") % 41 != 0, F.col("topic"))
    again = rows.filter("event_id % 11 = 0 AND event_type IN ('Reception', 'Deserialized')")
    log = (
        rows.withColumn("topic", lost)
        .unionByName(rows.filter("event_id % 7 = 0"))
        .unionByName(again.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 250 MILLISECONDS")))
    )
    return segment_samples(normalise_events(log))

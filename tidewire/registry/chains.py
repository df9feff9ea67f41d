"""Chains from raw input to stored results: growing logs, statistics documents, client documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.plans import scenarios as sc
from tidewire.registry import ORACLES, register
from tidewire.registry import sql_views as sql
from tidewire.registry.folders import _RUNS, _folder, _of
from tidewire.registry.ingest import log_lines, stats_documents
from tidewire.registry.scenarios import _range
from tidewire.registry.tables import table
from tidewire.schemas import (
    COMMON_DIMENSIONS,
    EXCLUSIVE_COUNT,
    EXCLUSIVE_TIME,
    NETWORK_DIMENSIONS,
    RESOURCE_COUNTERS,
    RUN,
)
from tidewire.session import materialise, scratch_path
from tidewire.sources.documents import client_files, read_client_documents, write_documents
from tidewire.sources.event_log import read_event_log
from tidewire.sources.resources import read_samples, write_samples
from tidewire.sources.scenarios import read_scenario_folder
from tidewire.sources.stats import read_stats_files, stats_samples
from tidewire.streaming.ingest import (
    drain_logs,
    ingest_new_logs,
    replace_logs,
    stream_log_events,
    stream_run_logs,
)


class _Lost(Exception):
    """Stands for a driver that is lost between a write and its commit."""


@register("ingest_increments", ORACLES["ingest_runs"])
def ingest_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs arriving in three steps; the second step's job is lost after it wrote, and runs again."""
    base, out = scratch_path(spark, "arriving-logs"), scratch_path(spark, "ingested")
    checkpoint = scratch_path(spark, "ingest-checkpoint")
    lines = materialise(
        log_lines(spark, sf_dir).withColumn("step", F.pmod(F.xxhash64("line"), F.lit(3))), "log-lines"
    )

    def arrive(step: int) -> None:
        for tech, run in _RUNS:
            mine = _of(lines, tech, run).filter(F.col("step") == step).select("line")
            mine.write.mode("append").text(_folder(base, tech, run))

    def lost(rows: DataFrame) -> None:
        replace_logs(rows, out)
        raise _Lost("after the write")

    arrive(0)
    ingest_new_logs(spark, base, out, checkpoint, "txt")
    arrive(1)
    try:
        drain_logs(stream_log_events(stream_run_logs(spark, base, "txt", 1000)), lost, checkpoint)
    except Exception as e:
        if _Lost.__name__ not in str(e):
            raise
    arrive(2)
    ingest_new_logs(spark, base, out, checkpoint, "txt")
    back = read_event_log(spark, out).drop("container_name")
    return back.withColumn("us", F.unix_micros("timestamp")).drop("timestamp")


@register(
    "stats_to_samples",
    sql.with_views(
        sql.RESOURCES
        + """,
gaps AS (
  SELECT *, CAST(cpu_usage_ns AS BIGINT) - lag(CAST(cpu_usage_ns AS BIGINT)) OVER w AS used,
         (us - lag(us) OVER w) * 10 AS total
  FROM res WHERE event_id % 101 <> 0
  WINDOW w AS (PARTITION BY scenario, tech, run, source ORDER BY us, event_id))""",
        """SELECT scenario, tech, run, source, us, cpu_usage_ns,
                  CASE WHEN total > 0
                    THEN round(CAST(used AS DOUBLE) / CAST(total AS DOUBLE)
                               * (CASE WHEN tech = 'alpha' THEN 4 ELSE 2 END) * 100, 2)
                    ELSE CAST(0 AS DOUBLE) END AS cpu_usage_perc,
                  memory_usage, page_cache,
                  network_rx + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS network_rx,
                  network_tx + CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END AS network_tx,
                  disk_read, disk_write
           FROM gaps""",
    ),
)
def stats_to_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics documents of all runs, as collected, to sample files and back."""
    base, out = scratch_path(spark, "stats-files"), scratch_path(spark, "samples")
    cpus = F.when(F.col("tech") == "alpha", 4).otherwise(2).alias("num_cpus")
    time = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")
    # The document is put into its line as it stands.
    head = F.rtrim(F.to_json(F.struct("container", time, cpus)), F.lit("}"))
    collected = stats_documents(spark, sf_dir).select(
        F.lit("logs").alias("logs_root"), *RUN, F.concat(head, F.lit(',"stats":'), "stats", F.lit("}")).alias("value")
    )
    for tech, run in _RUNS:
        _of(collected, tech, run).select("value").write.text(_folder(base, tech, run))
    write_samples(stats_samples(read_stats_files(spark, base, "txt"), RUN), out)
    back = read_samples(spark, out)
    return back.select(*RUN, "source", F.unix_micros("timestamp").alias("us"), *RESOURCE_COUNTERS)


def _definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scenario definition of a few combinations for every supplier, as a file."""
    key = F.col("s_suppkey")
    zero, one = _range(0, 0, 1), _range(1, 1, 1)
    common = {d: one for d in COMMON_DIMENSIONS} | {
        "numProducersPerTopic": _range(1, 1 + key % 2, 1),
        "numConsumers": _range(1, 3, 2),
        "numTopics": _range(2, 2, 1),
        "messageSizeBytes": _range(16 + key, 16 + key, 16),
        "producerWaitInMicroSeconds": _range(key * 5, key * 5, 1),
        "backlogSizeMessages": zero,
    }
    pack = lambda d: F.struct(*[v.alias(k) for k, v in d.items()])
    document = F.struct(
        F.array(F.lit("round-robin")).alias("producerAssignmentStrategy"),
        F.array(F.when(key % 3 == 0, "shared").otherwise("round-robin")).alias("consumerAssignmentStrategy"),
        pack(common).alias("common"),
        pack({d: zero for d in NETWORK_DIMENSIONS}).alias("network"),
        pack({EXCLUSIVE_TIME: _range(30, 30, 5), EXCLUSIVE_COUNT: _range(100 + key, 100 + key, 1)}).alias("exclusive"),
    )
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), key, F.lit(".json")).alias("file"), F.to_json(document).alias("document")
    )


@register(
    "scenario_client_documents",
    """WITH grid AS (
         SELECT k, p, c, goal FROM (SELECT s_suppkey AS k, unnest(range(1, 2 + s_suppkey % 2)) AS p FROM supplier),
                (SELECT unnest([1, 3]) AS c), (SELECT unnest(['m', 's']) AS goal)),
       named AS (
         SELECT *, 's' || k AS scenario,
                p || 'p' || c || 'c2t' || (16 + k) || 'b-' ||
                CASE goal WHEN 'm' THEN 100 + k ELSE 30 END || goal AS name
         FROM grid)
       SELECT scenario, 'alpha' AS tech, 'r0' AS run, name || '_alpha-P' || i AS file, 'P' || i AS client_id,
              '0,1' AS topics, k * 5 AS pub_rate, 16 + k AS message_size,
              CASE goal WHEN 'm' THEN 100 + k END AS n_messages,
              CASE goal WHEN 's' THEN 30::BIGINT END AS duration,
              c::BIGINT AS n_consumers, NULL::BIGINT AS backlog_size
       FROM (SELECT *, unnest(range(p)) AS i FROM named)
       UNION ALL
       SELECT scenario, 'alpha', 'r0', name || '_alpha-C' || i, 'C' || i,
              CASE WHEN k % 3 = 0 THEN '0,1' ELSE (i % 2)::VARCHAR END, NULL, NULL, NULL, NULL, NULL, 0
       FROM (SELECT *, unnest(range(c)) AS i FROM named)""",
)
def scenario_client_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From scenario files through their grids to one document per client, and back."""
    base = scratch_path(spark, "scenario-files")
    write_documents(_definitions(spark, sf_dir), f"{base}/scenarios")
    definitions = materialise(read_scenario_folder(spark, f"{base}/scenarios"), "definitions")
    grid = materialise(sc.scenarios_of(definitions), "scenarios")
    keyed = grid.select("*", F.struct("config", "name").alias("id"))
    documents = sc.config_documents(sc.publisher_configs(keyed, "id"), "id", "pub_id").unionByName(
        sc.config_documents(sc.consumer_configs(keyed, "id"), "id", "con_id")
    )
    placed = documents.select(
        F.col("id.config").alias("scenario"),
        F.lit("alpha").alias("tech"),
        F.lit("r0").alias("run"),
        F.col("id.name").alias("name"),
        "client_id",
        "document",
    )
    write_documents(client_files(placed), f"{base}/logs")
    fields = (
        "pub_id string, con_id string, topics array<string>, pub_rate bigint, message_size bigint, "
        "n_messages bigint, duration bigint, n_consumers bigint, backlog_size bigint"
    )
    back = read_client_documents(spark, f"{base}/logs").withColumn("d", F.from_json("document", fields))
    numbers = ["pub_rate", "message_size", "n_messages", "duration", "n_consumers", "backlog_size"]
    return back.select(
        *RUN,
        F.regexp_replace("file", "_0(?=[a-z])", "").alias("file"),
        F.coalesce("d.pub_id", "d.con_id").alias("client_id"),
        F.array_join("d.topics", ",").alias("topics"),
        *[F.col(f"d.{n}").alias(n) for n in numbers],
    )

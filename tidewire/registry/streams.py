"""Streaming queries, drained once and read back from their sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.payload import batch_limit
from tidewire.plans.throughput import curve_from_buckets
from tidewire.registry import register
from tidewire.registry import sql_views as sql
from tidewire.registry.messages import followed_streams, publisher_batches
from tidewire.registry.tables import (
    ORIGIN_US,
    event_rows,
    event_rows_from,
    messages,
    messages_from,
    termination_rows,
)
from tidewire.schemas import MESSAGE, PUBLICATION, RECEPTION, RUN, SERIALIZING
from tidewire.session import materialise, scratch_path
from tidewire.sources.event_log import normalise_events
from tidewire.streaming.completion import closing_counts, completion_times, settle_completion
from tidewire.streaming.kept import buckets_for, partitions_for
from tidewire.streaming.late import mark_late
from tidewire.streaming.latency import stream_pairs
from tidewire.streaming.microbatch import stream_batches
from tidewire.streaming.segments import settle_segments, stream_bounds, stream_segments
from tidewire.streaming.size_fill import filled_sizes
from tidewire.streaming.throughput import (
    drain_buckets,
    read_buckets,
    read_latest,
    stream_buckets,
    with_filled,
)
from tidewire.streaming.topics import drain_to_parquet, file_stream, only_topics

#: Steps in which a stream arrives, and the seconds of the run that one holds.
_FILES, _SPAN_S = 4, 200
#: Rows of the smallest step for each file of a step.
_ROWS_PER_FILE = 100_000
_RUN_TYPES = "scenario string, tech string, run string"


def _files_per_step(rows: list[int]) -> int:
    """Files that every step is written as: as many as the smallest step can fill beyond doubt."""
    return max(1, min(rows, default=0) // _ROWS_PER_FILE)


def _arriving(spark: SparkSession, rows: DataFrame, file: str) -> DataFrame:
    """``rows`` as a stream that arrives in steps, one per micro-batch; ``file`` numbers each row's step."""
    return _arriving_counted(spark, rows, file)[0]


def _arriving_counted(spark: SparkSession, rows: DataFrame, file: str) -> tuple[DataFrame, int]:
    """The stream of ``_arriving`` and the rows of its largest step.

    All steps have the same number of files, which a micro-batch takes: files are taken in the order
    in which they were written. Rows are dealt in turn, so no file is empty and left out.
    """
    folder = scratch_path(spark, "arrivals")
    dealt = materialise(rows.withColumn("_file", F.expr(file).cast("int")), "dealt")
    counts = {r["_file"]: r["count"] for r in dealt.groupBy("_file").count().collect()}
    files = _files_per_step([counts.get(k, 0) for k in range(_FILES)])
    for k in range(_FILES):
        step = dealt.filter(F.col("_file") == k).drop("_file")
        (step.coalesce(1) if files == 1 else step.repartition(files)).write.parquet(f"{folder}/{k}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files)
    return stream.parquet(f"{folder}/*/"), max(counts.values(), default=0)


def _drained(stream: DataFrame, label: str, partitions: int = 1) -> DataFrame:
    """The rows of an append stream once everything available has gone through."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    drain_to_parquet(stream, path, scratch_path(spark, f"{label}-checkpoint"), partitions=partitions)
    return spark.read.schema(stream.schema).parquet(path)


#: Every event arrives up to 40 seconds late, so stages of a message lie in different files.
_DELAYED = (
    f"greatest(0, least({_FILES - 1}, (us + (event_id * 7919 + length(event_type) * 13) % 40 * 1000000 - {ORIGIN_US}) "
    f"div {_SPAN_S * 1_000_000}))"
)


def _arriving_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    stream, most = _arriving_counted(spark, event_rows(spark, sf_dir), _DELAYED)
    return normalise_events(stream), most


def _message_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return messages_from(file_stream(spark, sf_dir, schema, "events.parquet"))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise_events(event_rows_from(_message_stream(spark, sf_dir)))


@register(
    "stream_topic_filter",
    sql.with_views(
        sql.MSG,
        """SELECT scenario, tech, run, message_id, topic, sz FROM msg
           WHERE topic IN ('view', 'purchase')""",
    ),
)
def stream_topic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    received = only_topics(_message_stream(spark, sf_dir), ["view", "purchase"])
    path = scratch_path(spark, "topic-sink")
    drain_to_parquet(received.select(*MESSAGE, "sz"), path, scratch_path(spark, "topic-checkpoint"))
    return spark.read.schema(
        "scenario string, tech string, run string, message_id string, topic string, sz bigint"
    ).parquet(path)


@register(
    "stream_throughput",
    sql.with_views(
        sql.curve(10),
        """SELECT scenario, tech, run, event_type, time_s,
                  round(throughput_mb_s, 9) AS throughput_mb_s FROM curve""",
    ),
)
def stream_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; sizes that a stage does not report come from the others, in any order."""
    events, _ = _arriving_events(spark, sf_dir)
    path = scratch_path(spark, "bucket-sink")
    drain_buckets(
        stream_buckets(events, lateness="60 seconds"), path, scratch_path(spark, "bucket-checkpoint")
    )
    filled = _drained(filled_sizes(events, lateness="60 seconds", horizon_ms=30_000), "fill-sink")
    curve = curve_from_buckets(with_filled(read_buckets(spark, path), filled), 10)
    return curve.withColumn("throughput_mb_s", F.round("throughput_mb_s", 9))


@register(
    "stream_latency_join",
    sql.with_views(
        sql.EVENTS,
        """SELECT a.scenario, a.tech, a.run, a.message_id, a.topic, a.container_name,
                  a.us // 1000 AS t0_ms, greatest(b.us // 1000 - a.us // 1000, 0) AS latency_ms
           FROM ev a JOIN ev b USING (scenario, tech, run, message_id, topic, container_name)
           WHERE a.event_type = 'Serializing' AND b.event_type = 'Publication'""",
    ),
)
def stream_latency_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One segment as a join of two streams."""
    pairs = stream_pairs(
        _event_stream(spark, sf_dir),
        _event_stream(spark, sf_dir),
        SERIALIZING,
        PUBLICATION,
        True,
        skew="5 seconds",
        horizon="60 seconds",
        lateness="60 seconds",
    )
    path = scratch_path(spark, "pair-sink")
    drain_to_parquet(pairs, path, scratch_path(spark, "pair-checkpoint"))
    return spark.read.schema(pairs.schema).parquet(path)


@register(
    "stream_latency_samples",
    sql.with_views(
        sql.SAMPLES,
        """SELECT scenario, tech, run, segment, time_s, latency_ms, count(*) AS weight
           FROM samples GROUP BY ALL""",
    ),
)
def stream_latency_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four segments from one keyed state; the end stage is settled per run."""
    events, most = _arriving_events(spark, sf_dir)
    path = scratch_path(spark, "bounds-sink")
    drain_buckets(stream_bounds(events), path, scratch_path(spark, "bounds-checkpoint"))
    bounds = read_latest(spark, path, RUN, _RUN_TYPES, "start_ms bigint, has_deserialized boolean")
    pairs = stream_segments(events, lateness="60 seconds", horizon_ms=30_000, buckets=buckets_for(most))
    return settle_segments(_drained(pairs, "segment-sink", partitions_for(most)), bounds)


@register(
    "stream_completion_counts",
    sql.with_views(
        sql.MSG
        + """,
streams AS (SELECT DISTINCT scenario, tech, run, p, topic FROM msg),
last AS (SELECT scenario, tech, run, max(t0) AS t FROM msg GROUP BY ALL),
term AS (
  SELECT s.*, c AS container, t + 1000000 + length(topic) * 1000
         + CASE WHEN tech = 'beta' AND run = 'r1' THEN 2000 ELSE 3000 END AS us
  FROM streams s JOIN last USING (scenario, tech, run), (VALUES ('C0'), ('C1')) v(c)
  WHERE c = 'C0' OR topic IN ('view', 'click')),
need AS (
  SELECT scenario, tech, run, container,
         CASE WHEN tech = 'alpha' THEN count(DISTINCT topic) ELSE count(*) END AS n
  FROM term GROUP BY scenario, tech, run, container),
nth AS (
  SELECT *, row_number() OVER (PARTITION BY scenario, tech, run, container ORDER BY us) AS i FROM term)""",
        """SELECT scenario, tech, run, tech || '-' || container AS container_name, n AS n_subscribed,
                  greatest(n - count(*), 0) AS remaining, min(CASE WHEN i >= n THEN us END) AS completed_us
           FROM nth JOIN need USING (scenario, tech, run, container)
           GROUP BY scenario, tech, run, container, n""",
    ),
)
def stream_completion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countdown of every consumer; one run logs no decoding and falls back to receptions."""
    rows = termination_rows(spark, sf_dir)
    plain = (F.col("tech") == "beta") & (F.col("run") == "r1")
    logged = rows.filter(~plain | (F.col("event_type") == RECEPTION))
    subscriptions = materialise(followed_streams(rows), "subscriptions")
    timed = logged.withColumn("timestamp", F.timestamp_micros("us"))
    events = normalise_events(
        _arriving(spark, timed, f"pmod(xxhash64(topic, event_type, container_name, p), {_FILES})")
    )
    path = scratch_path(spark, "count-sink")
    drain_buckets(closing_counts(events, subscriptions), path, scratch_path(spark, "count-checkpoint"))
    keys = [*RUN, "container_name"]
    counts = read_latest(
        spark, path, keys, f"{_RUN_TYPES}, container_name string", "decoded bigint, received bigint"
    )
    times = _drained(completion_times(events, subscriptions), "completion-sink")
    expected = subscriptions.groupBy(*keys).agg(F.sum("streams").cast("bigint").alias("n_subscribed"))
    return settle_completion(times, counts, expected)


@register(
    "stream_microbatch",
    publisher_batches(
        """SELECT scenario, tech, run, p, batch_id, count(*) AS n_rows, sum(sz)::BIGINT AS n_bytes,
                  min(t0) AS first_us, max(t0) AS published_us
           FROM fold GROUP BY scenario, tech, run, p, batch_id HAVING max(closed) = 1"""
    ),
)
def stream_microbatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of every publisher as they are published; failed sends stand in for closing messages."""
    rows = messages(spark, sf_dir).select(*RUN, "p", "event_id", "t0", "sz", "err")
    in_order = f"greatest(0, least({_FILES - 1}, (t0 - {ORIGIN_US}) div {_SPAN_S * 1_000_000}))"
    batches = stream_batches(
        _arriving(spark, rows, in_order), [*RUN, "p"], ["t0", "event_id"], "sz", batch_limit(0), F.col("err")
    )
    return _drained(batches, "batch-sink")


@register(
    "stream_late_rows",
    sql.with_views(
        sql.MSG
        + f""",
dealt AS (
  SELECT *, least({_FILES - 1}, greatest(0, (t0 - {ORIGIN_US}) // {_SPAN_S * 1_000_000}
            + CASE WHEN event_id % 29 = 0 THEN 1 ELSE 0 END)) AS file
  FROM msg),
marks AS (SELECT file, max(t0 // 1000) AS high_ms FROM dealt GROUP BY file),
passed AS (
  SELECT d.file, max(m.high_ms) - 5000 AS mark_ms
  FROM (SELECT DISTINCT file FROM dealt) d JOIN marks m ON m.file < d.file GROUP BY d.file)""",
        """SELECT scenario, tech, run, event_id, message_id, topic, sz, t0 AS us,
                  coalesce(t0 // 1000 < mark_ms, false) AS late
           FROM dealt LEFT JOIN passed USING (file)""",
    ),
)
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row in 29 arrives a file late; late and other rows together are all rows."""
    rows = messages(spark, sf_dir).select(
        *RUN, "event_id", "message_id", "topic", "sz", F.timestamp_micros("t0").alias("timestamp"), "t0"
    )
    file = (
        f"least({_FILES - 1}, greatest(0, (t0 - {ORIGIN_US}) div {_SPAN_S * 1_000_000} "
        "+ if(event_id % 29 = 0, 1, 0)))"
    )
    stream = _arriving(spark, rows, file).drop("t0")
    marked = _drained(mark_late(stream, "timestamp", lateness="5 seconds"), "late-sink")
    return marked.withColumn("us", F.unix_micros("timestamp")).drop("timestamp")

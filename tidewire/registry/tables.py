"""Views over the given tables in the shape of event logs and samples.

The 30 days of ``events`` are compressed 3600 times into a 720-second run, so
one-second hops and ten-second windows are meaningful.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORIGIN_US = 1_704_067_200_000_000
COMPRESSION = 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: Rows of a given table that one task takes at most, give or take the hash.
ROWS_PER_TASK = 65_536


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table dealt out by its key, the first column, to tasks of bounded size.

    Every event fans out to several rows of work. A file is cut by bytes, but read by row groups, so
    a split may hold millions of rows or none. Tasks are therefore as many as the rows ask for, and
    no fewer than there are cores. A table of at least as many files is left as it is.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_TASK))
    if len(df.inputFiles()) >= tasks:
        return df
    return df.repartition(tasks, df.columns[0])


_RUN_SQL = [
    "'demo' AS scenario",
    "if(user_id % 2 = 0, 'alpha', 'beta') AS tech",
    "if((user_id div 2) % 2 = 0, 'r0', 'r1') AS run",
]
_TIME_SQL = (
    f"{ORIGIN_US} + (unix_micros(cast(ts AS timestamp)) - {ORIGIN_US}) div {COMPRESSION}"
)


def messages_from(events: DataFrame) -> DataFrame:
    """One row per message of the event table."""
    base = events.selectExpr(
        "event_id",
        *_RUN_SQL,
        "concat('P', user_id % 3) AS p",
        "concat('P', user_id % 3, '-', event_id) AS message_id",
        "event_type AS topic",
        "cast(round(value * 1000) AS bigint) AS l",
        f"{_TIME_SQL} AS t0",
    )
    return base.selectExpr(
        "*",
        "cast(l + length(message_id) + 11 AS bigint) AS sz",
        "t0 + (event_id * 7919 % 23) * 1000 + event_id % 997 AS t1",
        "event_id % 211 = 0 AS err",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_from(table(spark, sf_dir, "events"))


def _stage(kind: str, container: str, us: str, logical: str, size: str) -> str:
    return (
        f"named_struct('event_type', {kind}, 'container_name', {container}, 'us', {us}, "
        f"'logical_size', cast({logical} AS bigint), 'serialized_size', cast({size} AS bigint))"
    )


def event_rows_from(msg: DataFrame, text_time: bool = False) -> DataFrame:
    """Raw event log rows: some sizes missing, failed sends included.

    The time is a timestamp, or text as a log file holds it.
    """
    publisher = "concat(tech, '-', p)"
    stages = [
        _stage("'Serializing'", publisher, "t0", "null", "null"),
        _stage(
            "if(err, 'DeliveryError', 'Publication')",
            publisher,
            "t1",
            "if(tech = 'alpha', -1, l)",
            "sz",
        ),
    ]
    for c in (0, 1):
        consumer = f"concat(tech, '-C{c}')"
        t2 = f"(t1 + ((event_id * 104729 + {c} * 31) % 400 - 5) * 1000)"
        received = _stage(
            "'Reception'", consumer, t2, "if(tech = 'beta', l, null)", "if(tech = 'beta', sz, null)"
        )
        decoded = _stage("'Deserialized'", consumer, f"{t2} + (event_id % 11) * 1000", "l", "sz")
        stages += [
            f"if(NOT err, {received}, null)",
            f"if(tech = 'alpha' AND NOT err AND event_id % 97 <> 0, {decoded}, null)",
        ]
    time = "timestamp_micros(s.us)"
    if text_time:
        time = f"date_format({time}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')"
    columns = ["event_id", "scenario", "tech", "run", "message_id", "topic"]
    return (
        msg.selectExpr(*columns, f"explode(array({', '.join(stages)})) AS s")
        .where("s IS NOT NULL")
        .selectExpr(*columns, "s.*", f"{time} AS timestamp")
    )


def event_rows(spark: SparkSession, sf_dir: str, text_time: bool = False) -> DataFrame:
    return event_rows_from(messages(spark, sf_dir), text_time)


def termination_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closing message of every publisher and topic, at each stage."""
    msg = messages(spark, sf_dir)
    last = msg.groupBy("scenario", "tech", "run").agg(F.max("t0").alias("last_us"))
    streams = msg.select("scenario", "tech", "run", "p", "topic").distinct()
    closing = [("Serializing", "p", 0), ("Publication", "p", 1)]
    for c in ("'C0'", "'C1'"):
        closing += [("Reception", c, 2), ("Deserialized", c, 3)]
    stages = ", ".join(
        f"named_struct('event_type', '{kind}', 'who', {who}, 'ms', {ms})" for kind, who, ms in closing
    )
    base = streams.join(last, ["scenario", "tech", "run"]).selectExpr("*", f"inline(array({stages}))")
    return base.selectExpr(
        "scenario",
        "tech",
        "run",
        "p",
        "topic",
        "concat(p, ':__END__') AS message_id",
        "event_type",
        "concat(tech, '-', who) AS container_name",
        "last_us + 1000000 + length(topic) * 1000 + ms * 1000 AS us",
        "1L AS logical_size",
        "cast(length(p) + 20 AS bigint) AS serialized_size",
    )


def resource_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw resource samples with null counters and resets."""
    who = "(user_id div 4) % 5"
    keyed = table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "value",
        *_RUN_SQL,
        f"element_at(array('P0', 'P1', 'Broker', 'C0', 'P2'), cast({who} AS int) + 1) AS label",
        f"{_TIME_SQL} AS us",
        "cast(round(value * 100) AS bigint) AS cents",
    )
    return keyed.selectExpr(
        "scenario",
        "tech",
        "run",
        "event_id",
        "if(label = 'Broker', concat('benchmark_', tech, '_broker'), concat(tech, '-', label)) AS container",
        "us",
        "date_format(timestamp_micros(us), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") AS timestamp",
        "event_id * 1000000 AS cpu_usage_ns",
        "value AS cpu_usage_perc",
        "cents * 10485 AS memory_usage",
        "event_id % 100 * 1048576 AS page_cache",
        "event_id * 1500 AS network_rx",
        "cents * 1000 AS network_tx",
        "if(event_id % 13 <> 0, event_id * 4096, null) AS disk_read",
        "event_id * 2048 AS disk_write",
    )

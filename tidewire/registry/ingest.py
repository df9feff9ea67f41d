"""Log, statistics and catalogue queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.lenient import parse_timestamp
from tidewire.registry import register
from tidewire.registry import sql_views as sql
from tidewire.registry.tables import event_rows, resource_rows, table
from tidewire.schemas import RUN
from tidewire.sources.catalog import nominal_duration, run_catalog, run_specs
from tidewire.sources.logs import level_counts, parse_study_lines, runtime_config
from tidewire.sources.stats import cpu_percent, flatten_stats


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows rendered as log lines, with other levels and malformed lines."""
    first = F.col("event_type") == "Serializing"
    ts, mid, topic = F.col("timestamp"), F.col("message_id"), F.col("topic")
    sizes = F.when(F.col("serialized_size").isNull(), F.lit("")).otherwise(
        F.concat(F.lit(","), F.col("logical_size"), F.lit(","), F.col("serialized_size"))
    )

    def study(*parts: Column) -> Column:
        return F.concat(F.lit("[STUDY] "), F.concat_ws(",", *parts))

    reception = F.lit("Reception")
    odd = first & (F.col("event_id") % 50 == 0)
    lines = [
        F.concat(study(ts, F.col("event_type"), mid, topic), sizes),
        F.when(
            first & (F.col("event_id") % 5 == 0),
            F.concat(F.lit("[INFO] "), ts, F.lit(",[PublisherApp] Published,"), mid, F.lit(","), topic),
        ),
        F.when(odd, study(ts, reception, mid)),
        F.when(odd, study(F.lit(" "), reception, mid, topic)),
        F.when(odd, study(ts, reception, mid, topic, F.lit("12.0"), F.lit("x"))),
        F.when(odd, study(ts, reception, mid, topic, F.lit("12.9"), F.lit(""))),
        F.when(odd, study(ts, reception, mid, topic, F.lit("1"), F.lit("2"), F.lit("3"))),
        F.when(
            odd,
            F.concat(
                F.lit("out [STUDY]  "),
                F.concat_ws(" , ", ts, reception, mid, topic, F.lit("+7"), F.lit("1_000 ")),
            ),
        ),
        F.when(odd, F.concat(F.lit("[TRACE] "), ts)),
        F.when(odd, F.lit("   ")),
    ]
    return (
        event_rows(spark, sf_dir, text_time=True)
        .select(*RUN, "container_name", F.explode(F.array(*lines)).alias("line"))
        .filter(F.col("line").isNotNull())
    )


@register(
    "log_parse",
    sql.with_views(
        sql.MSG_EVENTS
        + """,
texts AS (
  SELECT *, strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S.%f') AS timestamp FROM msg_events)""",
        """SELECT scenario, tech, run, container_name, timestamp, event_type, message_id,
                  logical_size, topic, serialized_size FROM texts
           UNION ALL
           SELECT scenario, tech, run, container_name, timestamp, 'Reception', message_id,
                  unnest([12, 7]), topic, unnest([NULL, 1000])
           FROM texts WHERE event_type = 'Serializing' AND event_id % 50 = 0""",
    ),
)
def log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_study_lines(log_lines(spark, sf_dir), [*RUN, "container_name"])


@register(
    "log_level_counts",
    sql.with_views(
        sql.MSG_EVENTS
        + """,
marks AS (SELECT event_id FROM msg_events WHERE event_type = 'Serializing')""",
        """SELECT 'STUDY' AS level, (SELECT count(*) FROM msg_events)
                  + 5 * (SELECT count(*) FROM marks WHERE event_id % 50 = 0) AS n_lines
           UNION ALL
           SELECT 'INFO', (SELECT count(*) FROM marks WHERE event_id % 5 = 0)
                  + 3 * (SELECT count(*) FROM marks WHERE event_id % 50 = 0)""",
    ),
)
def log_level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return level_counts(log_lines(spark, sf_dir))


@register(
    "timestamp_parse",
    """SELECT event_id,
              CASE event_id % 5 WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(ts)
                WHEN 2 THEN epoch_us(ts) // 1000000 * 1000000
                WHEN 3 THEN epoch_us(ts) // 1000 * 1000 END AS us
       FROM events""",
)
def timestamp_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    kind = F.col("event_id") % 5
    text = (
        F.when(kind == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .when(kind == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .when(kind == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(kind == 3, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"))
        .otherwise(F.date_format(ts, "HH:mm:ss"))
    )
    raw = table(spark, sf_dir, "events").select("event_id", text.alias("text"))
    return raw.select("event_id", F.unix_micros(parse_timestamp(F.col("text"))).alias("us"))


def config_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A start-up log for every customer row, with incomplete blocks among them."""
    key = F.col("c_custkey")
    head = "[CONFIG] 2025-01-01 10:00:00.000001,"
    end = F.lit(head + "[Client] [CONFIG_END]")
    lines = [
        F.when(key % 13 == 0, end),
        F.lit(head + "[CONFIG] EARLY=1"),
        F.when(key % 11 != 0, F.lit(head + "[Client] [CONFIG_BEGIN]")),
        F.concat(F.lit(head + "[CONFIG] URL=nats://h"), F.col("c_nationkey"), F.lit(":4222?x=y ")),
        F.concat(F.lit(head + "[CONFIG] TOPICS=0,1,"), F.col("c_mktsegment")),
        F.lit(head + "[CONFIG] NOVALUE"),
        F.lit("[INFO] a [CONFIG] A=1 [CONFIG] B = 2"),
        F.when(key % 2 == 0, F.concat(F.lit(head + "[CONFIG] TOPICS="), F.col("c_mktsegment"))),
        F.when(key % 7 != 0, end),
        F.lit(head + "[CONFIG] LATE=2"),
    ]
    return (
        table(spark, sf_dir, "customer")
        .select(
            F.concat(F.lit("client-"), key).alias("container_name"),
            F.posexplode(F.array(*lines)).alias("position", "line"),
        )
        .filter(F.col("line").isNotNull())
    )


@register(
    "runtime_config",
    """WITH ok AS (SELECT *, 'client-' || c_custkey AS container_name FROM customer
                   WHERE c_custkey % 11 <> 0 AND c_custkey % 13 <> 0)
       SELECT container_name, 'URL' AS key, 'nats://h' || c_nationkey || ':4222?x=y' AS value FROM ok
       UNION ALL SELECT container_name, 'B', '2' FROM ok
       UNION ALL SELECT container_name, 'TOPICS',
         CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '0,1,' || c_mktsegment END FROM ok
       UNION ALL SELECT container_name, 'LATE', '2' FROM ok WHERE c_custkey % 7 = 0""",
)
def runtime_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime_config(config_lines(spark, sf_dir))


def stats_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics documents whose figures are those of the resource samples."""
    raw = resource_rows(spark, sf_dir).fillna(0, ["disk_read"])
    eid = F.col("event_id")
    entry = lambda op, v: F.struct(F.lit(op).alias("op"), v.cast("bigint").alias("value"))
    net = lambda rx, tx: F.struct(rx.cast("bigint").alias("rx_bytes"), tx.cast("bigint").alias("tx_bytes"))
    one = F.create_map(F.lit("eth0"), net(F.col("network_rx"), F.col("network_tx")))
    two = F.map_concat(one, F.create_map(F.lit("eth1"), net(F.lit(1), F.lit(2))))
    half = F.expr("page_cache div 2")
    doc = F.struct(
        F.struct(
            F.struct(F.col("cpu_usage_ns").alias("total_usage")).alias("cpu_usage"),
            (F.col("us") * 10).alias("system_cpu_usage"),
        ).alias("cpu_stats"),
        F.when(
            eid % 101 != 0,
            F.struct(
                (F.col("memory_usage") + F.col("page_cache")).alias("usage"),
                F.struct(
                    F.when(eid % 2 == 0, F.col("page_cache")).alias("file"),
                    F.when(eid % 2 != 0, half).alias("active_file"),
                    F.when(eid % 2 != 0, F.col("page_cache") - half).alias("inactive_file"),
                ).alias("stats"),
            ),
        ).alias("memory_stats"),
        F.when(eid % 3 == 0, two).otherwise(one).alias("networks"),
        F.struct(
            F.array(
                entry("read", F.col("disk_read")),
                entry("write", F.col("disk_write")),
                entry("Read", F.lit(5)),
            ).alias("io_service_bytes_recursive")
        ).alias("blkio_stats"),
    )
    return raw.select(*RUN, "container", "event_id", "us", F.to_json(doc).alias("stats"))


@register(
    "stats_flatten",
    sql.with_views(
        sql.RESOURCES,
        """SELECT scenario, tech, run, event_id, us,
                  CAST(cpu_usage_ns AS BIGINT) AS cpu_usage_ns, us * 10 AS system_cpu_ns,
                  CAST(memory_usage AS BIGINT) AS memory_usage,
                  CAST(page_cache AS BIGINT) AS page_cache,
                  CAST(network_rx AS BIGINT) + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS network_rx,
                  CAST(network_tx AS BIGINT) + CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END AS network_tx,
                  CAST(disk_read AS BIGINT) AS disk_read, CAST(disk_write AS BIGINT) AS disk_write
           FROM res WHERE event_id % 101 <> 0""",
    ),
)
def stats_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_stats(stats_documents(spark, sf_dir), [*RUN, "event_id", "us"])


@register(
    "cpu_percent",
    sql.with_views(
        sql.RESOURCES
        + """,
gaps AS (
  SELECT *, CAST(cpu_usage_ns AS BIGINT) - lag(CAST(cpu_usage_ns AS BIGINT)) OVER w AS used,
         (us - lag(us) OVER w) * 10 AS total
  FROM res WHERE event_id % 101 <> 0
  WINDOW w AS (PARTITION BY scenario, tech, run, source ORDER BY us, event_id))""",
        """SELECT scenario, tech, run, event_id,
                  CASE WHEN total > 0
                    THEN round(CAST(used AS DOUBLE) / CAST(total AS DOUBLE) * 4 * 100, 2)
                    ELSE CAST(0 AS DOUBLE) END AS cpu_usage_perc
           FROM gaps""",
    ),
)
def cpu_percents(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = flatten_stats(stats_documents(spark, sf_dir), [*RUN, "container", "event_id", "us"])
    out = cpu_percent(flat, [*RUN, "container"], "us", ["event_id"], num_cpus=4)
    return out.select(*RUN, "event_id", "cpu_usage_perc")


def file_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder tree of log files, one path per order."""
    key = F.col("o_orderkey")
    tech = F.element_at(
        F.array(*[F.lit(t) for t in (".cache", "alpha", "beta", "gamma", "delta")]),
        (key % 5 + 1).cast("int"),
    )
    kind = F.floor(key / 7) % 4
    name = (
        F.when(kind == 0, F.concat(F.lit("1p1c1t10b-"), F.col("o_custkey") % 90, F.lit("s_events.parquet")))
        .when(kind == 1, F.lit("1p1c1t10b-100m_events.parquet"))
        .when(kind == 2, F.concat(F.lit("part"), key % 60, F.lit("sx.csv")))
        .otherwise(F.concat(F.lit("9p-"), key % 50, F.lit("s.csv")))
    )
    root = F.when(F.floor(key / 5) % 3 == 0, F.lit("logs")).otherwise(
        F.concat(F.lit("logs_v"), F.floor(key / 5) % 3)
    )
    run = F.concat(F.when(F.floor(key / 11) % 9 == 0, F.lit(".")).otherwise(F.lit("")), F.lit("run"), F.floor(key / 3) % 10)
    scenario = F.concat(F.lit("s"), F.col("o_custkey") % 40)
    return table(spark, sf_dir, "orders").select(
        F.concat_ws("/", F.lit("/data"), root, scenario, tech, run, name).alias("path")
    )


_PATHS = """
parts AS (
  SELECT CASE WHEN (o_orderkey // 5) % 3 = 0 THEN 'logs' ELSE 'logs_v' || (o_orderkey // 5) % 3 END AS logs_root,
         's' || (o_custkey % 40) AS scenario,
         ['.cache', 'alpha', 'beta', 'gamma', 'delta'][1 + o_orderkey % 5] AS tech,
         CASE WHEN (o_orderkey // 11) % 9 = 0 THEN '.' ELSE '' END || 'run' || (o_orderkey // 3) % 10 AS run,
         CASE (o_orderkey // 7) % 4 WHEN 0 THEN '1p1c1t10b-' || (o_custkey % 90) || 's_events.parquet'
           WHEN 1 THEN '1p1c1t10b-100m_events.parquet'
           WHEN 2 THEN 'part' || (o_orderkey % 60) || 'sx.csv'
           ELSE '9p-' || (o_orderkey % 50) || 's.csv' END AS name,
         CASE (o_orderkey // 7) % 4 WHEN 0 THEN o_custkey % 90 WHEN 3 THEN o_orderkey % 50 END AS seconds
  FROM orders)"""


@register(
    "run_catalog",
    sql.with_views(
        _PATHS, "SELECT DISTINCT logs_root, scenario, tech, run FROM parts WHERE tech <> '.cache'"
    ),
)
def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_catalog(file_paths(spark, sf_dir))


@register(
    "run_specs",
    sql.with_views(
        _PATHS,
        """SELECT DISTINCT logs_root, scenario, tech, run,
                  CASE tech WHEN 'gamma' THEN 1 ELSE 2 END::BIGINT AS tech_position
           FROM parts WHERE tech IN ('gamma', 'alpha')""",
    ),
)
def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_specs(run_catalog(file_paths(spark, sf_dir)), ["gamma", "alpha"])


@register(
    "nominal_duration",
    sql.with_views(
        _PATHS,
        """SELECT logs_root, scenario, arg_min(seconds, (tech, run, name)) AS duration_s
           FROM parts
           WHERE seconds IS NOT NULL AND tech <> '.cache' AND run NOT LIKE '.%'
           GROUP BY logs_root, scenario""",
    ),
)
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nominal_duration(file_paths(spark, sf_dir))

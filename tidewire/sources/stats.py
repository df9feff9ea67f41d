"""Container statistics documents to resource samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.labels import source_label
from tidewire.functions.lenient import once, parse_timestamp
from tidewire.operators.sliced_window import SLICE_US, with_previous
from tidewire.schemas import RESOURCE_COUNTERS, RUN, STATS_SCHEMA
from tidewire.session import materialise
from tidewire.sources.event_log import any_file, run_file_glob, run_keys_from_path

_COLLECTED = "container string, timestamp string, num_cpus int, stats string"


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("bigint"))


def _map_total(field: str) -> Column:
    values = F.map_values(F.col("s.networks"))
    total = F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + _or_zero(x[field]))
    return _or_zero(total)


def _op_total(op: str) -> Column:
    entries = F.filter(F.col("s.blkio_stats.io_service_bytes_recursive"), lambda x: x["op"] == op)
    total = F.aggregate(entries, F.lit(0).cast("bigint"), lambda a, x: a + _or_zero(x["value"]))
    return _or_zero(total)


def _filled(json_column: str, part: str) -> Column:
    """Whether a part of the document is an object with any field."""
    text = F.get_json_object(json_column, f"$.{part}")
    return F.coalesce(text.startswith("{") & ~text.rlike(r"^\{\s*\}$"), F.lit(False))


def flatten_stats(docs: DataFrame, keys: Sequence[str], json_column: str = "stats") -> DataFrame:
    """Counters and gauges of each document; map-only, and a document is parsed once.

    Documents without CPU or memory figures are dropped.
    """
    mem = "s.memory_stats"
    cpu = "s.cpu_stats"
    cache = F.coalesce(
        F.col(f"{mem}.stats.file"),
        _or_zero(F.col(f"{mem}.stats.active_file")) + _or_zero(F.col(f"{mem}.stats.inactive_file")),
    )
    has_cpu = F.col(f"{cpu}.cpu_usage.total_usage").isNotNull() | F.col(
        f"{cpu}.system_cpu_usage"
    ).isNotNull()
    has_memory = F.col(f"{mem}.usage").isNotNull() | F.col(f"{mem}.stats").isNotNull()
    # Other fields than the known ones make a part count as present, too.
    has_cpu |= _filled(json_column, "cpu_stats")
    has_memory |= _filled(json_column, "memory_stats")
    return (
        docs.select(*keys, json_column, once(F.from_json(json_column, STATS_SCHEMA)).alias("s"))
        .filter(has_cpu & has_memory)
        .select(
            *keys,
            _or_zero(F.col(f"{cpu}.cpu_usage.total_usage")).alias("cpu_usage_ns"),
            _or_zero(F.col(f"{cpu}.system_cpu_usage")).alias("system_cpu_ns"),
            F.greatest(_or_zero(F.col(f"{mem}.usage")) - cache, F.lit(0)).alias("memory_usage"),
            cache.alias("page_cache"),
            _map_total("rx_bytes").alias("network_rx"),
            _map_total("tx_bytes").alias("network_tx"),
            _op_total("read").alias("disk_read"),
            _op_total("write").alias("disk_write"),
        )
    )


def cpu_percent(
    samples: DataFrame,
    keys: list[str],
    time_us: str,
    tie: list[str],
    num_cpus: int | Column,
    slice_us: int = SLICE_US,
) -> DataFrame:
    """CPU use since the container's previous sample, in percent of one core.

    ``num_cpus`` is a column of ``samples`` where hosts differ. The samples are written first, as
    they are read twice and are mostly made of parsed documents.
    """
    cpus = num_cpus if isinstance(num_cpus, Column) else F.lit(num_cpus)
    linked = with_previous(
        materialise(samples, "stats-samples"), keys, time_us, tie, ["cpu_usage_ns", "system_cpu_ns"], slice_us=slice_us
    )
    used = (F.col("cpu_usage_ns") - F.col("prev_cpu_usage_ns")).cast("double")
    total = F.col("system_cpu_ns") - F.col("prev_system_cpu_ns")
    percent = F.when(
        (total > 0) & (cpus > 0), F.round(used / total * cpus * 100, 2)
    ).otherwise(F.lit(0.0))
    return linked.withColumn("cpu_usage_perc", percent).drop(
        "prev_cpu_usage_ns", "prev_system_cpu_ns"
    )


def read_stats_files(
    spark: SparkSession, base: str, suffix: str = "jsonl", **selection: Sequence[str]
) -> DataFrame:
    """Collected statistics of ``logs*/scenario/tech/run/*.<suffix>``, one JSON object a line.

    An object holds the ``container``, the ``timestamp`` of the sample, ``num_cpus`` of its host and
    the ``stats`` document, which stays text here.
    """
    pattern = run_file_glob(base, suffix, **selection)
    if not any_file(spark, pattern):
        keys = ", ".join(f"{k} string" for k in RUN)
        return spark.createDataFrame([], f"{keys}, {_COLLECTED}")
    return (
        spark.read.text(pattern)
        .select(
            *run_keys_from_path(F.col("_metadata.file_path")),
            once(F.from_json("value", _COLLECTED)).alias("c"),
        )
        .select(*RUN, "c.*")
    )


def stats_samples(docs: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Resource samples of collected statistics, as ``write_samples`` takes them.

    Documents without CPU or memory figures give no sample and do not count as the previous one;
    neither do documents without a readable time. Samples of equal time are taken in the order of
    their CPU counters, which only grow. A host of unknown size counts as one CPU.
    """
    timed = docs.withColumn("timestamp", parse_timestamp(F.col("timestamp"))).filter("timestamp IS NOT NULL")
    kept = ["container", "timestamp", "num_cpus"]
    flat = flatten_stats(timed, [*keys, *kept]).withColumn("us", F.unix_micros("timestamp"))
    cpus = F.coalesce(F.col("num_cpus"), F.lit(1))
    samples = cpu_percent(
        flat, [*keys, "container"], "us", ["cpu_usage_ns", "system_cpu_ns"], num_cpus=cpus
    )
    return samples.select(
        *keys,
        source_label(F.col("container")).alias("source"),
        "timestamp",
        *[F.col(c).cast("double").alias(c) for c in RESOURCE_COUNTERS],
    )

"""Throughput over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.schemas import RUN

_KEYS = [*RUN, "event_type", "second"]


def stream_buckets(events: DataFrame, *, lateness: str) -> DataFrame:
    """Bytes per run, event type and second; state is dropped behind the watermark.

    Rows later than ``lateness`` are not counted (Spark reports their number as
    ``numRowsDroppedByWatermark``), so the caller must name it.

    Sizes are those each event reports itself. Sliding windows are summed from
    these buckets on read, so the state holds one row per second, not one per
    window.
    """
    return (
        events.withWatermark("timestamp", lateness)
        .groupBy(*RUN, "event_type", F.window("timestamp", "1 second").alias("w"))
        .agg(
            F.sum("serialized_size").alias("bytes"),
            F.count("serialized_size").alias("sized"),
            F.unix_millis(F.min("timestamp")).alias("first_ms"),
        )
        .select(
            *RUN,
            "event_type",
            F.unix_seconds("w.start").alias("second"),
            "bytes",
            "sized",
            "first_ms",
        )
    )


def drain_buckets(buckets: DataFrame, path: str, checkpoint: str) -> None:
    """Write the changed rows of an aggregate, buckets or others, of every micro-batch.

    Each micro-batch owns one folder, so a batch that is run again replaces
    what it wrote before.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = (
        buckets.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_latest(spark: SparkSession, path: str, keys: list[str], key_types: str, values: str) -> DataFrame:
    """Latest row of every key among those that ``drain_buckets`` wrote."""
    stored = spark.read.schema(f"{key_types}, {values}, batch_id bigint").parquet(path)
    names = [c for c in stored.columns if c not in (*keys, "batch_id")]
    latest = F.max_by(F.struct(*names), "batch_id").alias("v")
    return stored.groupBy(*keys).agg(latest).select(*keys, "v.*")


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """Latest value of every bucket."""
    return read_latest(
        spark,
        path,
        _KEYS,
        "scenario string, tech string, run string, event_type string, second bigint",
        "bytes bigint, sized bigint, first_ms bigint",
    )


def with_filled(buckets: DataFrame, filled: DataFrame) -> DataFrame:
    """Buckets plus the bytes that ``filled_sizes`` found for rows without a size."""
    found = filled.withColumn("first_ms", F.lit(None).cast("bigint"))
    return buckets.unionByName(found).groupBy(*_KEYS).agg(
        F.sum("bytes").alias("bytes"), F.sum("sized").alias("sized"), F.min("first_ms").alias("first_ms")
    )

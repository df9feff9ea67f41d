"""Topic sources and sinks, and the receive-side topic filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from tidewire.session import least_partitions


def file_stream(
    spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet"
) -> DataFrame:
    """Parquet files of a folder as a stream, for replays and tests."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def topic_stream(spark: SparkSession, servers: str, topics: Sequence[str], **options: str) -> DataFrame:
    """Messages of the subscribed topics from a Kafka-compatible broker.

    Needs the Kafka connector package on the cluster.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics))
    )
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load().select(
        F.col("key").cast("string").alias("key"), "topic", F.col("value").alias("wire"), "timestamp"
    )


def to_topics(messages: DataFrame, servers: str, checkpoint: str) -> DataStreamWriter:
    """Keyed messages to their topics; ``messages`` has message_id, topic and wire."""
    rows = messages.select(
        F.col("message_id").cast("binary").alias("key"), F.col("wire").alias("value"), "topic"
    )
    return (
        rows.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("checkpointLocation", checkpoint)
    )


def only_topics(messages: DataFrame, topics: Sequence[str]) -> DataFrame:
    """Messages of the subscribed topics; others are dropped on receipt."""
    return messages.filter(F.col("topic").isin(*topics))


def drain_to_parquet(stream: DataFrame, path: str, checkpoint: str, *, partitions: int = 1) -> None:
    """Process everything available now into a Parquet sink.

    State lies in ``partitions`` at least; the session may have more. A checkpoint keeps its number.
    """
    writer = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
    )
    with least_partitions(stream.sparkSession, partitions):
        query = writer.start()
    query.awaitTermination()

"""Raw container logs that keep arriving, parsed into the event log as they come."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.labels import file_stem
from tidewire.schemas import RUN
from tidewire.sources.event_log import normalise_events, run_file_glob, run_keys_from_path
from tidewire.sources.logs import parse_study_lines

#: Partition of the event log that holds the rows of one log file.
LOG = "log"


def stream_run_logs(
    spark: SparkSession,
    base: str,
    suffix: str = "log",
    max_files: int | None = None,
    **selection: Sequence[str],
) -> DataFrame:
    """Log lines of ``logs*/scenario/tech/run/*.<suffix>`` as a stream.

    Every file is read once, in one micro-batch of at most ``max_files`` files, so a log has to
    appear under its name when it is complete. ``log`` names the file within its run.
    """
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    path = F.col("_metadata.file_path")
    lines = reader.load(run_file_glob(base, suffix, **selection)).select(
        *run_keys_from_path(path),
        file_stem(path).alias("container_name"),
        F.rtrim("value", F.lit("\r")).alias("line"),
    )
    return lines.withColumn(LOG, F.concat_ws("/", "logs_root", "container_name")).drop("logs_root")


def stream_log_events(lines: DataFrame) -> DataFrame:
    """Event rows of ``stream_run_logs``; map-only, so the stream keeps no state."""
    return normalise_events(parse_study_lines(lines, [*RUN, LOG, "container_name"]), [*RUN, LOG])


def replace_logs(events: DataFrame, path: str) -> None:
    """Write the rows of whole logs, each over what an earlier write left of the same log.

    A micro-batch that runs again after a failure therefore leaves every row once, whether its
    first attempt was lost before, during or after the write. Rows are written by the tasks that
    parsed them: a task reads one split of a log, or a few small logs, so nothing is shuffled and a
    log has a file for each of its splits.
    """
    events.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *RUN, LOG
    ).parquet(path)


def drain_logs(events: DataFrame, write: Callable[[DataFrame], None], checkpoint: str) -> None:
    """Hand every log that has arrived since the last call to ``write``, batch by batch."""
    query = (
        events.writeStream.foreachBatch(lambda rows, _: write(rows))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def ingest_new_logs(
    spark: SparkSession,
    base: str,
    path: str,
    checkpoint: str,
    suffix: str = "log",
    max_files: int = 1000,
    **selection: Sequence[str],
) -> None:
    """Bring the event log at ``path`` up to date with the logs below ``base``.

    Only files that ``checkpoint`` does not know are opened. ``read_event_log`` reads the result.
    """
    lines = stream_run_logs(spark, base, suffix, max_files, **selection)
    drain_logs(stream_log_events(lines), lambda rows: replace_logs(rows, path), checkpoint)

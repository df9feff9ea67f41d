"""Raw container logs: readers and line parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.labels import file_stem, level_of_line
from tidewire.functions.lenient import once, size_field, trim_blanks
from tidewire.schemas import RUN
from tidewire.sources.event_log import any_file, run_file_glob, run_keys_from_path


def read_container_logs(spark: SparkSession, path: str, keyed: bool = False) -> DataFrame:
    """Lines of one log file per container, in any encoding damage, with position.

    ``position`` orders the lines of a file: the offset of the file split, then
    the reading order inside it. With ``keyed`` the run keys are taken from the
    folders. A file that cannot be read to its end fails the job; half a log
    is never taken for a whole one.
    """
    return (
        spark.read.text(path)
        .select(
            *(run_keys_from_path(F.col("_metadata.file_path")) if keyed else []),
            file_stem(F.col("_metadata.file_path")).alias("container_name"),
            F.struct(
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("row"),
            ).alias("position"),
            F.rtrim("value", F.lit("\r")).alias("line"),
        )
    )


def read_run_logs(
    spark: SparkSession, base: str, suffix: str = "log", **selection: Sequence[str]
) -> DataFrame:
    """Log lines of ``logs*/scenario/tech/run/*.<suffix>`` with the run keys of their folder."""
    pattern = run_file_glob(base, suffix, **selection)
    if not any_file(spark, pattern):
        return spark.createDataFrame(
            [],
            ", ".join(f"{k} string" for k in ("logs_root", *RUN, "container_name"))
            + ", position struct<block: bigint, row: bigint>, line string",
        )
    return read_container_logs(spark, pattern, keyed=True)


#: The comma-separated parts of a marked line.
_PARTS = ["timestamp", "event_type", "message_id", "topic", "logical_size", "serialized_size"]


def parse_study_lines(
    lines: DataFrame, keys: Sequence[str] = ("container_name",), level: str = "STUDY"
) -> DataFrame:
    """Event log rows of the marked lines; map-only, malformed lines dropped.

    After the marker come at most six comma-separated parts: time, stage,
    message, topic and optionally the two sizes. Fewer than four parts, a blank
    time or a size that is not a number drop the line.
    """
    marker = f"[{level}]"
    line = F.col("line")
    rest = F.substr(line, F.locate(marker, line) + len(marker))
    cut = lines.filter(line.contains(marker)).select(*keys, once(F.split(rest, ",", 6)).alias("parts"))
    trimmed = [trim_blanks(F.get("parts", F.lit(i))).alias(n) for i, n in enumerate(_PARTS)]
    named = cut.filter(F.size("parts") >= 4).select(*keys, once(F.struct(*trimmed)).alias("p"))

    def filled(name: str) -> Column:
        return F.coalesce(F.col(f"p.{name}"), F.lit("")) != ""

    sizes = [size_field(F.col(f"p.{n}")).alias(n) for n in _PARTS[4:]]
    sized = named.filter(filled("timestamp")).select(*keys, "p", once(F.struct(*sizes)).alias("s"))
    for n in _PARTS[4:]:
        sized = sized.filter(~filled(n) | F.col(f"s.{n}").isNotNull())
    return sized.select(
        *keys,
        "p.timestamp",
        "p.event_type",
        "p.message_id",
        "s.logical_size",
        "p.topic",
        "s.serialized_size",
    )


def level_counts(lines: DataFrame) -> DataFrame:
    """Lines per log level; lines without a known level count as INFO."""
    return lines.groupBy(level_of_line(F.col("line")).alias("level")).agg(
        F.count(F.lit(1)).alias("n_lines")
    )


# Fixed value: a setting inside the configuration block; the last tag counts.
SETTING_PATTERN = r"(?s)^.*\[CONFIG\] ([^=]+)=(.+)"


def runtime_config(lines: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Settings between the begin and end tag of every container, last value wins.

    A container is named by ``keys``: by default its name and, where ``lines``
    has them, the run keys, so equal names of different runs stay apart.

    ``lines`` needs a ``position`` that orders a container's lines. Only lines
    with a tag or a setting take part, and both aggregates combine before the
    shuffle.
    """
    if keys is None:
        keys = [k for k in ("logs_root", *RUN) if k in lines.columns] + ["container_name"]
    line = F.col("line")
    is_begin = line.contains("[CONFIG_BEGIN]")
    is_end = line.contains("[CONFIG_END]") & ~is_begin
    block = (
        lines.filter(is_begin | is_end)
        .groupBy(*keys)
        .agg(
            F.min(F.when(is_begin, F.col("position"))).alias("begin"),
            F.min(F.when(is_end, F.col("position"))).alias("end"),
        )
        .filter(F.col("begin").isNotNull())
    )
    key = trim_blanks(F.regexp_extract("line", SETTING_PATTERN, 1))
    value = trim_blanks(F.regexp_extract("line", SETTING_PATTERN, 2))
    settings = (
        lines.filter(line.rlike(SETTING_PATTERN) & ~is_begin & ~is_end)
        .select(*keys, "position", key.alias("key"), value.alias("value"))
    )
    inside = (F.col("position") > F.col("begin")) & (
        F.col("end").isNull() | (F.col("position") < F.col("end"))
    )
    return (
        settings.join(block, list(keys))
        .filter(inside)
        .groupBy(*keys, "key")
        .agg(F.max_by("value", "position").alias("value"))
    )

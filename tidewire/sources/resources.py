"""Resource samples: header-tolerant CSV reader, normalisation and sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.labels import file_stem, source_label
from tidewire.functions.lenient import parse_timestamp
from tidewire.schemas import RESOURCE_COUNTERS, RUN
from tidewire.session import materialise
from tidewire.sources.event_log import any_file, run_file_glob, run_keys_from_path


def _counter(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(0.0).alias(name)
    return F.coalesce(F.col(name).try_cast("double"), F.lit(0.0)).alias(name)


def normalise_samples(
    df: DataFrame, stem: Column, keys: Sequence[str] = RUN, extra: Sequence[str] = ()
) -> DataFrame:
    """Typed samples with a source label; missing and null counters count as 0."""
    have = dict(df.dtypes)["timestamp"]
    ts = F.col("timestamp").cast("timestamp") if have.startswith("timestamp") else parse_timestamp(
        F.col("timestamp")
    )
    return df.select(
        *keys,
        *extra,
        source_label(stem).alias("source"),
        ts.alias("timestamp"),
        *[_counter(df, c) for c in RESOURCE_COUNTERS],
    )


def _csv_cells(line: Column) -> Column:
    """The cells of a CSV line; quoted cells may hold commas and doubled quotes."""
    quoted = F.transform(
        F.regexp_extract_all(line, F.lit(r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'), F.lit(1)),
        lambda c: F.when(
            c.startswith('"') & c.endswith('"') & (F.length(c) >= 2),
            F.regexp_replace(F.substr(c, F.lit(2), F.length(c) - 2), '""', '"'),
        ).otherwise(c),
    )
    return F.when(line.contains('"'), quoted).otherwise(F.split(line, ","))


def _resource_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """``file, start, line`` of every line; a large file is read by many tasks.

    ``start`` is the place in the file at which the line's task began.
    """
    return spark.read.text(pattern, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.regexp_replace("value", "^\ufeff|\r\\z", "").alias("line"),
    )


def _resource_headers(spark: SparkSession, pattern: str) -> DataFrame:
    """``file, first, header`` of every file with a line: one narrow row each, written."""
    # Rows of a task are numbered in order, and one task alone reads a file's start.
    firsts = (
        _resource_lines(spark, pattern)
        .filter("start = 0")
        .withColumn("at", F.monotonically_increasing_id())
        .groupBy("file")
        .agg(F.min_by("line", "at").alias("first"))
    )
    return materialise(
        firsts.select("file", "first", _csv_cells(F.col("first")).alias("header")), "resource-headers"
    )


def unread_resource_files(spark: SparkSession, base: str, **selection: Sequence[str]) -> DataFrame:
    """``file, reason`` of the CSV files whose samples cannot be placed in time."""
    pattern = run_file_glob(base, "csv", **selection)
    if not any_file(spark, pattern):
        return spark.createDataFrame([], "file string, reason string")
    empty = F.trim(F.coalesce("first", F.lit(""))) == ""
    # Files are listed, not opened; one without any line has no header row.
    files = spark.read.format("binaryFile").load(pattern).select(F.col("_metadata.file_path").alias("file"))
    return (
        files.join(_resource_headers(spark, pattern), "file", "left")
        .filter(~F.coalesce(F.array_contains("header", "timestamp"), F.lit(False)))
        .select("file", F.when(empty, "no header").otherwise("no timestamp column").alias("reason"))
    )


def read_resource_files(spark: SparkSession, base: str, **selection: Sequence[str]) -> DataFrame:
    """Samples of ``logs*/scenario/tech/run/*.csv``.

    The first line of a file is its header, whichever column leads and however it is quoted;
    values are matched to it by name, as older files lack some columns. The headers are found first
    and joined to the lines by file; files are read in splits, so a container with very many samples
    is many tasks. Files without a ``timestamp`` column are those that ``unread_resource_files``
    lists.
    """
    pattern = run_file_glob(base, "csv", **selection)
    if not any_file(spark, pattern):
        ddl = ", ".join(f"{k} string" for k in ("logs_root", *RUN, "source"))
        ddl += ", timestamp timestamp, " + ", ".join(f"{c} double" for c in RESOURCE_COUNTERS)
        return spark.createDataFrame([], ddl)
    line = F.col("line")
    headers = _resource_headers(spark, pattern).filter(F.array_contains("header", "timestamp"))
    rows = (
        _resource_lines(spark, pattern)
        .join(headers, "file")
        # The header itself; a writer that was started again repeats it.
        .filter((line != "") & (line != F.col("first")))
        .select("file", *run_keys_from_path(F.col("file")), "header", _csv_cells(line).alias("cells"))
    )

    def cell(name: str) -> Column:
        return F.get("cells", (F.array_position("header", name) - 1).cast("int")).alias(name)

    flat = rows.select("logs_root", *RUN, "file", *[cell(c) for c in ("timestamp", *RESOURCE_COUNTERS)])
    return normalise_samples(flat, file_stem(F.col("file")), ["logs_root", *RUN])


def write_samples(samples: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header, one folder per run."""
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")
    keys = [k for k in RUN if k in samples.columns]
    flat = samples.select(*keys, "source", iso, *RESOURCE_COUNTERS)
    flat.hint("rebalance", *keys, "source").write.mode(mode).option("header", True).option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(*keys, "source").csv(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples written by ``write_samples``; key filters prune folders."""
    columns = ", ".join(["timestamp string", *[f"{c} double" for c in RESOURCE_COUNTERS]])
    keys = ", ".join(f"{k} string" for k in [*RUN, "source"])
    raw = spark.read.schema(f"{columns}, {keys}").option("header", True).csv(path)
    return raw.select(
        *RUN,
        "source",
        parse_timestamp(F.col("timestamp")).alias("timestamp"),
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in RESOURCE_COUNTERS],
    )

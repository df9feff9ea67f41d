"""Run catalogue from the folder layout ``<logs root>/<scenario>/<tech>/<run>``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.labels import file_stem
from tidewire.schemas import RUN
from tidewire.sources.event_log import run_keys_from_path

# Fixed value: a nominal duration in a file name.
DURATION_PATTERN = r"([0-9]+)s(?:$|[^0-9A-Za-z])"
DEFAULT_ROOT = "logs"


def list_run_files(spark: SparkSession, base: str, roots: str = "logs*") -> DataFrame:
    """Paths of all files below the log roots; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .load(f"{base.rstrip('/')}/{roots}/*/*/*/*")
        .select(F.col("path"))
    )


def run_inputs(spark: SparkSession, pattern: str) -> DataFrame:
    """Number, bytes and last change of the files of every run; contents are not read.

    A stored result is current while these are what they were when it was made.
    """
    found = spark.read.format("binaryFile").load(pattern)
    return (
        found.select(*run_keys_from_path(F.col("path"))[1:], "length", "modificationTime")
        .groupBy(*RUN)
        .agg(
            F.count(F.lit(1)).alias("n_files"),
            F.sum("length").alias("n_bytes"),
            F.unix_micros(F.max("modificationTime")).alias("changed_us"),
        )
    )


def run_catalog(paths: DataFrame) -> DataFrame:
    """Distinct runs; hidden technology folders are left out."""
    keyed = paths.select(*run_keys_from_path(F.col("path")))
    return keyed.filter(~F.col("tech").startswith(".")).distinct()


def log_roots(catalog: DataFrame) -> DataFrame:
    """Known roots, the conventional one first."""
    return (
        catalog.select("logs_root")
        .distinct()
        .withColumn("is_default", F.col("logs_root") == DEFAULT_ROOT)
    )


def run_specs(catalog: DataFrame, techs: Sequence[str]) -> DataFrame:
    """Runs of the selected technologies, with the place of each in the selection."""
    order = F.array(*[F.lit(t) for t in techs])
    return (
        catalog.filter(F.col("tech").isin(*techs))
        .select(*[c for c in catalog.columns if c == "logs_root"], *RUN)
        .withColumn("tech_position", F.array_position(order, F.col("tech")))
    )


def selected_runs(specs: DataFrame) -> DataFrame:
    """Run names over all selected technologies, each once."""
    return specs.select("run").distinct().orderBy("run")


def nominal_duration(paths: DataFrame) -> DataFrame:
    """Seconds named by the first matching file of each scenario, in path order."""
    stem = file_stem(F.col("path"))
    name = F.element_at(F.split("path", "/"), -1)
    in_stem = F.regexp_extract(stem, DURATION_PATTERN, 1)
    found = F.when(in_stem != "", in_stem).otherwise(F.regexp_extract(name, DURATION_PATTERN, 1))
    return (
        paths.select(*run_keys_from_path(F.col("path")), name.alias("name"), found.alias("found"))
        .filter(~F.col("tech").startswith(".") & ~F.col("run").startswith("."))
        .filter(F.col("found") != "")
        .groupBy("logs_root", "scenario")
        .agg(F.min_by("found", F.struct("tech", "run", "name")).alias("found"))
        .select("logs_root", "scenario", F.col("found").cast("bigint").alias("duration_s"))
    )

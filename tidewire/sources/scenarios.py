"""Scenario and batch definitions from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.labels import file_stem
from tidewire.schemas import BATCH_SCHEMA, SCENARIO_SCHEMA
from tidewire.sources.documents import read_documents


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """One row per scenario file: ``config`` (its name) and the parsed definition."""
    return (
        spark.read.schema(SCENARIO_SCHEMA)
        .option("multiLine", True)
        .json(path)
        .select(file_stem(F.col("_metadata.file_path")).alias("config"), "*")
    )


def read_scenario_folder(spark: SparkSession, path: str) -> DataFrame:
    """``read_scenarios`` of all ``*.json`` of a folder, listed and opened by the tasks."""
    parsed = parse_scenario(F.col("document")).alias("s")
    return read_documents(spark, path, 0, ".json").select(file_stem(F.col("file")).alias("config"), parsed).select(
        "config", "s.*"
    )


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BATCH_SCHEMA).option("multiLine", True).json(path)


def parse_scenario(c: Column) -> Column:
    return F.from_json(c, SCENARIO_SCHEMA)


def parse_batch(c: Column) -> Column:
    return F.from_json(c, BATCH_SCHEMA)

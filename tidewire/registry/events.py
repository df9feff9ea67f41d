"""Normalised event view shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewire.registry.tables import event_rows
from tidewire.sources.event_log import normalise_events


def events(spark: SparkSession, sf_dir: str, text_time: bool = False) -> DataFrame:
    return normalise_events(event_rows(spark, sf_dir, text_time))

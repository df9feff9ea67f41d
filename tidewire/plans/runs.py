"""Per-run facts: time origin and which stages were logged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.schemas import DESERIALIZED, RUN


def run_bounds(events: DataFrame) -> DataFrame:
    """First and last event time and the decoded flag; one row per run."""
    return events.groupBy(*RUN).agg(
        F.unix_millis(F.min("timestamp")).alias("start_ms"),
        F.unix_millis(F.max("timestamp")).alias("end_ms"),
        F.bool_or(F.col("event_type") == DESERIALIZED).alias("has_deserialized"),
        F.count(F.lit(1)).alias("n_events"),
    )

"""Fill missing message sizes from other lifecycle stages of the same message."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.schemas import DESERIALIZED, MESSAGE, PUBLICATION, RECEPTION, SERIALIZING


def size_lookup(events: DataFrame) -> DataFrame:
    """One row per message with the size its publication and its decode reported.

    All copies of a message report one size, so ``min`` picks it without
    depending on row order, and the partial aggregate collapses hot messages
    before the shuffle.
    """
    size = F.col("serialized_size")
    return (
        events.filter(
            F.col("event_type").isin(PUBLICATION, DESERIALIZED)
            & size.isNotNull()
            & F.col("topic").isNotNull()
        )
        .groupBy(*MESSAGE)
        .agg(
            F.min(F.when(F.col("event_type") == PUBLICATION, size)).alias("published_size"),
            F.min(F.when(F.col("event_type") == DESERIALIZED, size)).alias("decoded_size"),
        )
    )


def _fill_rule() -> Column:
    kind = F.col("event_type")
    return (
        F.when(kind == SERIALIZING, F.col("published_size"))
        .when(kind == RECEPTION, F.col("decoded_size"))
        .otherwise(F.coalesce("published_size", "decoded_size"))
    )


def recovered_sizes(events: DataFrame, event_types: Sequence[str] | None = None) -> DataFrame:
    """Only the rows that lacked a size, with the size found for them.

    ``event_types`` limits the rows, not the stages sizes are taken from.

    Rows that already have a size never reach this join, and rows without a
    topic cannot match, so neither is shuffled. The lookup side holds one row
    per message, which lets adaptive execution split a hot message on the
    event side.
    """
    missing = events.filter(F.col("serialized_size").isNull() & F.col("topic").isNotNull())
    if event_types is not None:
        missing = missing.filter(F.col("event_type").isin(*event_types))
    return (
        missing.drop("serialized_size")
        .join(size_lookup(events), MESSAGE, "left")
        .withColumn("serialized_size", _fill_rule())
        .drop("published_size", "decoded_size")
    )


def fill_sizes(events: DataFrame) -> DataFrame:
    """Every event row, with missing sizes filled where a sibling knows them."""
    untouched = events.filter(F.col("serialized_size").isNotNull() | F.col("topic").isNull())
    return untouched.unionByName(recovered_sizes(events))

"""Latency samples from two event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.schemas import MESSAGE


def _side(events: DataFrame, event_type: str, keys: list[str], at: str, lateness: str) -> DataFrame:
    return (
        events.filter(F.col("event_type") == event_type)
        .select(*[F.col(k).alias(f"{at}_{k}") for k in keys], F.col("timestamp").alias(at))
        .withWatermark(at, lateness)
    )


def stream_pairs(
    events: DataFrame,
    other: DataFrame,
    start_type: str,
    end_type: str,
    same_container: bool,
    *,
    skew: str,
    horizon: str,
    lateness: str,
    unmatched: bool = False,
) -> DataFrame:
    """Start and end of each message as they arrive.

    Pairs lie between ``skew`` before and ``horizon`` after the start, which
    with the watermarks bounds the state both sides keep; the caller knows the
    queues and must name all three. With ``unmatched`` starts and ends without
    a partner inside the bounds are kept, too, once the watermark has passed
    them: their other time is null, so what the bounds cost can be counted.
    """
    keys = [*MESSAGE, "container_name"] if same_container else MESSAGE
    a = _side(events, start_type, keys, "t0", lateness)
    b = _side(other, end_type, keys, "t1", lateness)
    matches = F.expr(f"t1 BETWEEN t0 - INTERVAL {skew} AND t0 + INTERVAL {horizon}")
    for k in keys:
        matches = (F.col(f"t0_{k}") == F.col(f"t1_{k}")) & matches
    latency = F.greatest(F.unix_millis("t1") - F.unix_millis("t0"), F.lit(0)).cast("bigint")
    if unmatched:
        return a.join(b, matches, "full_outer").select(
            *[F.coalesce(f"t0_{k}", f"t1_{k}").alias(k) for k in keys],
            F.unix_millis("t0").alias("t0_ms"),
            F.unix_millis("t1").alias("t1_ms"),
        )
    return a.join(b, matches, "inner").select(
        *[F.col(f"t0_{k}").alias(k) for k in keys],
        F.unix_millis("t0").alias("t0_ms"),
        latency.alias("latency_ms"),
    )

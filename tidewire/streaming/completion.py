"""Closing messages counted over a stream."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.schemas import DESERIALIZED, RECEPTION, RUN, TERMINATION_SUFFIX
from tidewire.streaming.kept import fold_groups

_CONSUMER = [*RUN, "container_name"]
#: Times of the first closing messages by stage, and the completion time already emitted.
_KEPT = pa.schema([("event_type", pa.string()), ("us", pa.int64()), ("sent", pa.bool_())])


def closing_counts(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Closing messages per run, consumer and stage so far; one state row each.

    Only topics that the consumer subscribed count. ``subscriptions`` is a
    static table of run keys, container_name and topic.
    """
    topics = subscriptions.select(*RUN, "container_name", "topic").distinct()
    return (
        events.filter(
            F.col("event_type").isin(DESERIALIZED, RECEPTION)
            & F.col("message_id").endswith(TERMINATION_SUFFIX)
        )
        .join(topics, [*RUN, "container_name", "topic"], "left_semi")
        .groupBy(*RUN, "container_name")
        .agg(
            F.count(F.when(F.col("event_type") == DESERIALIZED, 1)).alias("decoded"),
            F.count(F.when(F.col("event_type") == RECEPTION, 1)).alias("received"),
        )
    )


def remaining_streams(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """Streams a consumer still waits for; never below zero.

    In a run where no consumer has decoded a closing message the received ones
    count, as some transports never log the decoding.
    """
    keys = [*RUN, "container_name"]
    decodes = counts.groupBy(*RUN).agg(F.max("decoded").alias("most_decoded"))
    seen = counts.join(decodes, RUN).select(
        *keys,
        F.when(F.col("most_decoded") > 0, F.col("decoded")).otherwise(F.col("received")).alias("n_seen"),
    )
    return expected.join(seen, keys, "left").select(
        *keys,
        "n_subscribed",
        F.greatest(
            F.col("n_subscribed") - F.coalesce("n_seen", F.lit(0)), F.lit(0).cast("bigint")
        ).alias("remaining"),
    )


def countdown_step(
    kept: pd.DataFrame, new: pd.DataFrame, watermark_ms: int
) -> tuple[pd.DataFrame, pd.DataFrame]:
    """A completion time as soon as the countdown ends; again only if an earlier message shows up."""
    n = int(new["n_subscribed"].iloc[0])
    out, held = [], []
    for stage in (DESERIALIZED, RECEPTION):
        mine = kept[kept["event_type"] == stage]
        sent = mine.loc[mine["sent"], "us"].min()
        times = pd.concat([mine.loc[~mine["sent"], "us"], new.loc[new["event_type"] == stage, "us"]])
        # Later ones than the first n can no longer be the n-th.
        times = times.sort_values().head(n)
        if len(times) == n and n and not sent <= times.iloc[-1]:
            sent = times.iloc[-1]
            out.append((stage, int(sent)))
        held += [(stage, int(t), False) for t in times]
        if pd.notna(sent):
            held.append((stage, int(sent), True))
    made = pd.DataFrame(out, columns=["event_type", "completed_us"])
    for k in _CONSUMER:
        made[k] = new[k].iloc[0]
    return made, pd.DataFrame(held, columns=_KEPT.names)


def completion_times(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(run keys, container_name, event_type, completed_us) as consumers finish.

    A consumer counts down one closing message at a time from the number of streams it
    subscribed; its state holds no more times than that. Both stages count, as only the whole run
    tells which one it logs (``settle_completion``). ``subscriptions`` is a static table of run
    keys, container_name, topic and ``streams``.
    """
    topics = subscriptions.select(*_CONSUMER, "topic").distinct()
    expected = subscriptions.groupBy(*_CONSUMER).agg(F.sum("streams").cast("bigint").alias("n_subscribed"))
    closing = events.filter(
        F.col("event_type").isin(DESERIALIZED, RECEPTION)
        & F.col("message_id").endswith(TERMINATION_SUFFIX)
        & F.col("timestamp").isNotNull()
    ).join(topics, [*_CONSUMER, "topic"], "left_semi")
    rows = closing.join(expected, _CONSUMER).select(
        *_CONSUMER, "event_type", F.unix_micros("timestamp").alias("us"), "n_subscribed"
    )
    kinds = dict(rows.dtypes)
    output = ", ".join([f"{k} {kinds[k]}" for k in _CONSUMER] + ["event_type string, completed_us bigint"])
    return fold_groups(rows, _CONSUMER, countdown_step, output, _KEPT)


def settle_completion(times: DataFrame, counts: DataFrame, expected: DataFrame) -> DataFrame:
    """Streams seen and left, and the completion time, of every consumer.

    ``times`` and ``counts`` are what ``completion_times`` and ``closing_counts`` stored.
    """
    decodes = counts.groupBy(*RUN).agg((F.max("decoded") > 0).alias("decodes"))
    first = times.groupBy(*_CONSUMER, "event_type").agg(F.min("completed_us").alias("completed_us"))
    kind = F.when(F.col("decodes"), F.lit(DESERIALIZED)).otherwise(F.lit(RECEPTION))
    done = first.join(decodes, RUN).filter(F.col("event_type") == kind)
    left = remaining_streams(counts, expected)
    return left.join(done.select(*_CONSUMER, "completed_us"), _CONSUMER, "left")

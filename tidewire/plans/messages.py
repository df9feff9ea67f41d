"""Message datasets: workload tables and stream completion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.sliced_window import SLICE_US, with_previous
from tidewire.schemas import DESERIALIZED, RECEPTION, RUN, TERMINATION_SUFFIX

CHUNK = 65536
# A portable pseudo-random pick from the message number.
_PICK_FACTOR, _PICK_TERM, _PICK_SHIFT = 1103515245, 12345, 16
# Numbers wrap here, so that the product fits 64 bits however many messages there are.
_PICK_RANGE = 1 << 31


def workload(
    publishers: DataFrame,
    samples: int = 5,
    key: str = "scenario_id",
    seed: int = 0,
    chunk: int = CHUNK,
    first_seq: int = 1,
) -> DataFrame:
    """The messages every publisher sends: numbered, sampled, one per topic.

    Numbers run from 1 when messages are counted and from 0 when a duration
    ends the run (``first_seq``). A publisher's messages are made in chunks spread over
    the cluster, so a large one is not a single row's array.
    """
    first = F.col("chunk") * chunk + first_seq
    last = F.least(F.col("n_messages"), (F.col("chunk") + 1) * chunk) + (first_seq - 1)
    number = F.pmod(F.col("seq") + seed, F.lit(_PICK_RANGE))
    pick = F.shiftright(number * _PICK_FACTOR + _PICK_TERM, _PICK_SHIFT)
    return (
        publishers.filter(F.col("n_messages") > 0)
        .select(
            key,
            "pub_id",
            "topics",
            "n_messages",
            F.explode(
                F.sequence(
                    F.lit(0).cast("bigint"), F.floor((F.col("n_messages") - 1) / chunk)
                )
            ).alias("chunk"),
        )
        .repartition(key, "pub_id", "chunk")
        .select(key, "pub_id", "topics", F.explode(F.sequence(first, last)).alias("seq"))
        .select(
            key,
            "pub_id",
            "seq",
            F.concat("pub_id", F.lit("-"), "seq").alias("message_id"),
            F.pmod(pick, F.lit(samples)).alias("sample"),
            F.explode("topics").alias("topic"),
        )
    )


def closing_events(events: DataFrame) -> DataFrame:
    """Decoded closing messages; received ones where a transport logs no decode."""
    closing = events.filter(F.col("message_id").endswith(TERMINATION_SUFFIX))
    wanted = closing.filter(F.col("event_type").isin(RECEPTION, DESERIALIZED))
    has = wanted.groupBy(*RUN).agg(
        F.bool_or(F.col("event_type") == DESERIALIZED).alias("decoded")
    )
    kind = F.when(F.col("decoded"), F.lit(DESERIALIZED)).otherwise(F.lit(RECEPTION))
    return wanted.join(has, RUN).filter(F.col("event_type") == kind).drop("decoded")


def stream_completion(
    closing: DataFrame, subscriptions: DataFrame, slice_us: int = SLICE_US
) -> DataFrame:
    """When each consumer had seen as many closing messages as it subscribed streams.

    ``closing`` has run keys, container_name, topic, message_id and ``us``;
    ``subscriptions`` has run keys, container_name, topic and ``streams``, the
    number of streams counted for that topic: one for transports that count
    topics, the number of publishers for those that count both. A consumer
    still waiting has no completion time.
    """
    keys = [*RUN, "container_name"]
    expected = subscriptions.groupBy(*keys).agg(F.sum("streams").cast("bigint").alias("n_subscribed"))
    seen = closing.join(
        subscriptions.select(*keys, "topic").distinct(), [*keys, "topic"], "left_semi"
    )
    ordered = with_previous(
        seen, keys, "us", ["topic", "message_id"], [], ordinal="nth", slice_us=slice_us
    )
    done = (
        ordered.join(expected, keys)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_seen"),
            F.min(F.when(F.col("nth") >= F.col("n_subscribed"), F.col("us"))).alias("completed_us"),
        )
    )
    return expected.join(done, keys, "left").select(
        *keys, "n_subscribed", F.coalesce("n_seen", F.lit(0).cast("bigint")).alias("n_seen"), "completed_us"
    )

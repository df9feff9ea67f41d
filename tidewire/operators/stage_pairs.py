"""Latency samples between lifecycle stages, as weighted rows.

The stage-to-stage joins of the event log are replaced by one grouped pass:
every (message, container) collapses, before the shuffle, to one row holding
the time and the number of copies of each stage. Segments inside one container
are read off that row; the segments between containers need one join of these
compact rows. A container that logged a message at several different times in
one stage does not fit the row. Such rows, if there are any, are replaced by
rows of distinct times from a second read of the log, so the result is the full
inner join in all cases, while exact copies only raise a weight.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.schemas import (
    DESERIALIZED,
    END_TO_END,
    MESSAGE,
    PUBLICATION,
    PUB_TO_REC,
    RECEPTION,
    REC_TO_DES,
    RUN,
    SERIALIZING,
    SER_TO_PUB,
)
from tidewire.session import materialise

_STAGE = {"ser": SERIALIZING, "pub": PUBLICATION, "rec": RECEPTION, "des": DESERIALIZED}

# Whether a run ends at Deserialized or Reception is decided per run later.
E2E_DECODED = "end_to_end/decoded"
E2E_RECEIVED = "end_to_end/received"

# (start stage, end stage, joined on container too, segment)
_SEGMENTS = [
    ("ser", "pub", True, SER_TO_PUB),
    ("pub", "rec", False, PUB_TO_REC),
    ("rec", "des", True, REC_TO_DES),
    ("ser", "des", False, E2E_DECODED),
    ("ser", "rec", False, E2E_RECEIVED),
]


def message_stages(events: DataFrame) -> DataFrame:
    """One row per (message, container): time and count of each stage.

    ``<stage>_ms`` and ``<stage>_hi`` are the first and last time. The state has
    constant size and is combined before the shuffle, so a message with very
    many copies costs no more than any other.
    """
    ms = F.unix_millis("timestamp")
    aggs = []
    for s, name in _STAGE.items():
        at = F.when(F.col("event_type") == name, ms)
        aggs += [
            F.count(at).alias(f"{s}_n"),
            F.min(at).alias(f"{s}_ms"),
            F.max(at).alias(f"{s}_hi"),
        ]
    spread = reduce(
        lambda a, b: a | b,
        [F.coalesce(F.col(f"{s}_ms") < F.col(f"{s}_hi"), F.lit(False)) for s in _STAGE],
    )
    return (
        events.groupBy(*MESSAGE, "container_name")
        .agg(*aggs, F.bool_or(F.col("event_type") == DESERIALIZED).alias("decoded"))
        .withColumn("scattered", spread)
    )


def stage_bounds(stages: DataFrame) -> DataFrame:
    """Run start and decoded flag, read off the compact rows."""
    first = F.least(*[F.col(f"{s}_ms") for s in _STAGE])
    return stages.groupBy(*RUN).agg(
        F.min(first).alias("start_ms"), F.bool_or("decoded").alias("has_deserialized")
    )


def _segment_rows(df: DataFrame, specs: list[tuple[str, str, bool, str]]) -> DataFrame:
    pairs = F.array(
        *[
            F.struct(
                F.lit(segment).alias("segment"),
                F.col(f"{a}_ms").alias("t0_ms"),
                F.col(f"{b}_ms").alias("t1_ms"),
                (F.col(f"{a}_n") * F.col(f"{b}_n")).alias("weight"),
            )
            for a, b, _, segment in specs
        ]
    )
    return df.select(*RUN, F.inline(pairs)).filter(F.col("weight") > 0)


def _across(rows: DataFrame) -> DataFrame:
    """Segments between containers; every time of a stage stands in one row of its container."""
    start = rows.filter((F.col("ser_n") > 0) | (F.col("pub_n") > 0)).select(
        *MESSAGE, "ser_ms", "ser_n", "pub_ms", "pub_n"
    )
    end = rows.filter((F.col("rec_n") > 0) | (F.col("des_n") > 0)).select(
        *MESSAGE, "rec_ms", "rec_n", "des_ms", "des_n"
    )
    return _segment_rows(start.join(end, MESSAGE), [s for s in _SEGMENTS if not s[2]])


def _distinct_times(events: DataFrame, scattered: DataFrame) -> DataFrame:
    """The scattered (message, container) rows again, one row per stage and distinct time."""
    log = events.filter(
        F.col("timestamp").isNotNull() & F.col("event_type").isin(*_STAGE.values())
    ).select(*MESSAGE, "container_name", "event_type", F.unix_millis("timestamp").alias("ms"))
    same = [F.col(f"log.{k}") == F.col(f"scattered.{k}") for k in MESSAGE]
    same.append(F.col("log.container_name").eqNullSafe(F.col("scattered.container_name")))
    counted = (
        log.alias("log")
        .join(scattered.alias("scattered"), same, "left_semi")
        .groupBy(*MESSAGE, "container_name", "event_type", "ms")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    stages = []
    for s, name in _STAGE.items():
        own = F.col("event_type") == name
        stages += [
            F.when(own, F.col("ms")).alias(f"{s}_ms"),
            F.when(own, F.col("n")).otherwise(F.lit(0).cast("bigint")).alias(f"{s}_n"),
        ]
    return materialise(counted.select(*MESSAGE, "container_name", *stages), "scattered-stages")


def _within(times: DataFrame) -> list[DataFrame]:
    """Segments inside the containers of ``_distinct_times``."""
    keys = [*MESSAGE, "container_name"]
    parts = []
    for spec in [s for s in _SEGMENTS if s[2]]:
        a, b = (
            times.filter(F.col(f"{s}_n") > 0).select(*keys, f"{s}_ms", f"{s}_n") for s in spec[:2]
        )
        parts.append(_segment_rows(a.join(b, keys), [spec]))
    return parts


def weighted_pairs(events: DataFrame, stages: DataFrame) -> DataFrame:
    """(run keys, segment, t0_ms, latency_ms, weight), end-to-end in both forms.

    ``stages`` is the written ``message_stages(events)``. The events are read
    again only when some row is scattered.
    """
    matchable = stages.filter(F.col("topic").isNotNull())
    scattered = matchable.filter("scattered")
    times = [f"{s}_{k}" for s in _STAGE for k in ("ms", "n")]
    rows = matchable.filter(~F.col("scattered")).select(*MESSAGE, "container_name", *times)
    # What one container logged does not depend on the others, so only scattered rows are joined.
    local = _segment_rows(
        rows.filter(F.col("container_name").isNotNull()), [s for s in _SEGMENTS if s[2]]
    )
    if scattered.isEmpty():
        pairs = local.unionByName(_across(rows))
    else:
        again = _distinct_times(events, scattered.select(*MESSAGE, "container_name"))
        pairs = reduce(
            DataFrame.unionByName, [local, *_within(again), _across(rows.unionByName(again))]
        )
    return pairs.select(
        *RUN,
        "segment",
        "t0_ms",
        F.greatest(F.col("t1_ms") - F.col("t0_ms"), F.lit(0)).cast("bigint").alias("latency_ms"),
        "weight",
    )


def settle_end_to_end(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """Keep the end-to-end form that fits the run and drop the marker."""
    flags = bounds.select(*RUN, "has_deserialized")
    keep = (
        F.when(F.col("segment") == E2E_DECODED, F.col("has_deserialized"))
        .when(F.col("segment") == E2E_RECEIVED, ~F.col("has_deserialized"))
        .otherwise(F.lit(True))
    )
    return (
        df.join(flags, RUN)
        .filter(keep)
        .withColumn(
            "segment",
            F.when(F.col("segment").isin(E2E_DECODED, E2E_RECEIVED), F.lit(END_TO_END)).otherwise(
                F.col("segment")
            ),
        )
        .drop("has_deserialized")
    )

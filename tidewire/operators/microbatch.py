"""Byte-bounded batches: rows are appended in order, and the row that brings a
batch to the limit (or forces it) closes the batch.

The counter restarts at every close, so the rule is a fold over the rows of a
key. To keep one key from becoming one task, each key is cut into slices. What
a slice does to the bytes carried into it depends only on which of its first
rows closes the first batch, so a slice is summed up by one entry per such row.
Summaries are combined into blocks, blocks into blocks of blocks, until one is
left of every key; the state that enters each is handed down the same levels, so
no group grows with the key. With the carried bytes known every slice numbers
its own rows in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators.sliced_window import with_previous
from tidewire.session import materialise

_FORCED = 2**62
#: Blocks that are combined into one of the next level.
_FAN_IN = 16
_SUMMARY = (
    "_first array<bigint>, _carry array<bigint>, _closed array<bigint>, _total bigint"
)


def _next_close(cum: np.ndarray, forced: np.ndarray, limit: int) -> np.ndarray:
    """For every row: the row closing the batch that starts right after it."""
    n = len(cum)
    by_size = np.searchsorted(cum, cum + limit, side="left")
    marks = np.flatnonzero(forced)
    if len(marks) == 0:
        return by_size
    after = np.searchsorted(marks, np.arange(n), side="right")
    by_force = np.where(after < len(marks), marks[np.minimum(after, len(marks) - 1)], n)
    return np.minimum(by_size, by_force)


def _summarise(size: np.ndarray, forced: np.ndarray, limit: int):
    n = len(size)
    cum = np.cumsum(size)
    following = _next_close(cum, forced, limit)
    # Last close of the chain that starts at each row, by doubling the steps.
    more = following < n
    end = np.where(more, following, np.arange(n))
    closed = more.astype("i8")
    while True:
        further = end[end]
        if np.array_equal(further, end):
            break
        closed = closed + closed[end]
        end = further
    carry, closed = cum[-1] - cum[end], closed + 1
    # Rows after the first certain close never close a carried batch.
    certain = (cum >= limit) | forced
    stop = int(np.argmax(certain)) + 1 if certain.any() else n
    reach = np.where(forced[:stop], _FORCED, cum[:stop])
    return reach, carry[:stop], closed[:stop], int(cum[-1])


def _apply(first, carry, closed, total, limit, held, count):
    """Carried bytes and closed batches after a summary, for arrays of states."""
    k = np.searchsorted(first, limit - held, side="left")
    hit = k < len(first)
    at = np.minimum(k, max(len(first) - 1, 0))
    if len(first) == 0:
        return held + total, count
    return np.where(hit, carry[at], held + total), np.where(hit, count + closed[at], count)


def _compose(parts: list[tuple], limit: int):
    first = np.empty(0, dtype="i8")
    held = np.empty(0, dtype="i8")
    count = np.empty(0, dtype="i8")
    before, open_ = 0, True
    for f, c, n, total in parts:
        held, count = _apply(f, c, n, total, limit, held, count)
        if open_:
            shifted = np.where(f >= _FORCED, _FORCED, f + before)
            first = np.concatenate([first, shifted])
            held = np.concatenate([held, c])
            count = np.concatenate([count, n])
            before += total
            open_ = before < limit and not (len(f) and f[-1] >= _FORCED)
    total = sum(p[3] for p in parts)
    return first, held, count, total


def _parts(table: pa.Table) -> list[tuple]:
    first, carry, closed = (
        table[c].combine_chunks() for c in ("_first", "_carry", "_closed")
    )
    total = table["_total"].to_pylist()
    return [
        tuple(a[i].values.to_numpy() for a in (first, carry, closed)) + (total[i],)
        for i in range(table.num_rows)
    ]


def _summary_row(table: pa.Table, columns: list[str], made: tuple) -> pa.Table:
    lists = [pa.array([np.asarray(v, dtype="i8")], pa.list_(pa.int64())) for v in made[:3]]
    head = table.select(columns).slice(0, 1)
    return pa.Table.from_arrays(
        [*head.columns, *lists, pa.array([made[3]], pa.int64())],
        names=[*columns, "_first", "_carry", "_closed", "_total"],
    )


def _with_states(table: pa.Table, columns: list[str], states: list[tuple]) -> pa.Table:
    held, count = (pa.array([s[i] for s in states], pa.int64()) for i in (0, 1))
    return pa.Table.from_arrays(
        [*table.select(columns).columns, held, count], names=[*columns, "_held", "_count"]
    )


def _walk(parts: list[tuple], limit: int, held: int, count: int):
    """State before each part when they are passed in order."""
    states = []
    for part in parts:
        states.append((held, count))
        h, n = _apply(*part, limit, np.array([held]), np.array([count]))
        held, count = int(h[0]), int(n[0])
    return states


def assign_batches(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    size: str,
    limit: int,
    forced: Column | None = None,
    rows_per_slice: int = 50_000,
    slices_per_block: int = 256,
    slice_us: int = 1_000_000,
) -> DataFrame:
    """Add ``batch_id``, counted from 0 within each key.

    ``order`` starts with a time in microseconds and must tell all rows of a key
    apart; ``size`` is a bigint. Rows are numbered along the key first, so a
    slice never holds more than ``rows_per_slice`` of them, however many fall
    into one second. Keys must not be null.
    """
    keys = list(keys)
    columns = list(rows.columns)
    force = F.lit(False) if forced is None else F.coalesce(forced, F.lit(False))
    numbered = with_previous(
        rows.withColumn("_force", force),
        keys,
        order[0],
        list(order[1:]),
        [],
        ordinal="_nth",
        slice_us=slice_us,
    ).select(*columns, "_force", "_nth")
    sliced = materialise(
        numbered.withColumn(
            "_slice", F.floor((F.col("_nth") - 1) / rows_per_slice).cast("bigint")
        ),
        "batch-rows",
    )
    slim = sliced.select(*keys, "_slice", "_nth", F.col(size).alias("_size"), "_force")
    types = dict(sliced.dtypes)
    key_ddl = ", ".join(f"`{k}` {types[k]}" for k in keys)

    def summarise(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_nth")
        made = _summarise(rows["_size"].to_numpy(), rows["_force"].to_numpy(), limit)
        return _summary_row(rows, [*keys, "_slice"], made)

    summaries = materialise(
        slim.groupBy(*keys, "_slice").applyInArrow(
            summarise, f"{key_ddl}, _slice bigint, {_SUMMARY}"
        ),
        "batch-slices",
    )
    def compose(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_slice")
        return _summary_row(rows, [*keys, "_block"], _compose(_parts(rows), limit))

    def spread(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_slice")
        entry = (rows["_held"][0].as_py(), rows["_count"][0].as_py())
        return _with_states(rows, [*keys, "_slice"], _walk(_parts(rows), limit, *entry))

    # Every level names its members _slice and the member of the next level _block.
    levels = []
    level, fan_in = summaries, slices_per_block
    while level.agg(F.max("_slice")).first()[0]:
        levels.append(level.withColumn("_block", F.floor(F.col("_slice") / fan_in)))
        made = levels[-1].groupBy(*keys, "_block").applyInArrow(
            compose, f"{key_ddl}, _block bigint, {_SUMMARY}"
        )
        level = materialise(made.withColumnRenamed("_block", "_slice"), "batch-blocks")
        fan_in = _FAN_IN
    nothing = F.lit(0).cast("bigint")
    states = level.select(*keys, "_slice", nothing.alias("_held"), nothing.alias("_count"))
    for members in reversed(levels):
        entered = states.withColumnRenamed("_slice", "_block")
        states = materialise(
            members.join(entered, [*keys, "_block"])
            .groupBy(*keys, "_block")
            .applyInArrow(spread, f"{key_ddl}, _slice bigint, _held bigint, _count bigint"),
            "batch-states",
        )

    ddl = ", ".join(f"`{c}` {types[c]}" for c in columns)

    def number(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_nth")
        cum = np.cumsum(rows[size].to_numpy())
        mark = rows["_force"].to_numpy()
        following = _next_close(cum, mark, limit)
        certain = (cum + rows["_held"][0].as_py() >= limit) | mark
        closes = np.zeros(len(cum), dtype="i8")
        at = int(np.argmax(certain)) if certain.any() else len(cum)
        while at < len(cum):
            closes[at] = 1
            at = int(following[at])
        batch = rows["_count"][0].as_py() + np.cumsum(closes) - closes
        return rows.select(columns).append_column("batch_id", pa.array(batch, pa.int64()))

    return (
        sliced.join(states, [*keys, "_slice"])
        .groupBy(*keys, "_slice")
        .applyInArrow(number, f"{ddl}, batch_id bigint")
    )


def summarise_batches(assigned: DataFrame, keys: Sequence[str], at: str, size: str) -> DataFrame:
    """Rows, bytes, first and last time of each batch; it is published at its last row."""
    return assigned.groupBy(*keys, "batch_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(size).alias("n_bytes"),
        F.min(at).alias("first_us"),
        F.max(at).alias("published_us"),
    )

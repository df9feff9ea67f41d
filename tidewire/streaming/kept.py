"""Keyed state of a stream as small tables that are worked on as a whole.

A group's state is one packed Arrow table. In every micro-batch its new rows and the kept ones go
through one vectorised step, which returns rows to emit and rows to keep. Groups are buckets of a
hash where the keys are many (messages), so the cost is one call per bucket and micro-batch instead
of one per message, and a hot run is spread over all buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: kept rows, new rows, watermark in milliseconds (0 before the first) to emitted and kept rows.
Step = Callable[[pd.DataFrame, pd.DataFrame, int], tuple[pd.DataFrame, pd.DataFrame]]
#: Parts of a group's new rows as one table that stands for all of them.
Combine = Callable[[list[pd.DataFrame]], pd.DataFrame]
#: New rows of a group that wait to be combined, and emitted rows that are handed over at once.
WAITING_ROWS, EMITTED_ROWS = 65_536, 10_000
#: Rows of a micro-batch that a bucket takes, give or take the hash, and the fewest buckets.
ROWS_PER_BUCKET, FEWEST_BUCKETS = 16_384, 64
#: Rows of a micro-batch that one task sorts by bucket, give or take the hash.
ROWS_PER_PARTITION = 500_000


def coded(texts: pd.Series) -> pa.DictionaryArray:
    """Texts as numbers into a dictionary of those that occur."""
    if not isinstance(texts.dtype, pd.CategoricalDtype):
        return pa.array(texts, pa.string(), from_pandas=True).dictionary_encode()
    codes, known = texts.cat.codes.to_numpy("int32"), texts.cat.categories
    used = np.zeros(len(known) + 1, bool)
    used[codes] = True
    used[-1] = False
    number = np.cumsum(used, dtype="int32") - 1
    return pa.DictionaryArray.from_arrays(
        pa.array(number[codes], mask=codes < 0), pa.array(known[used[:-1]], pa.string())
    )


def _pack(table: pd.DataFrame, schema: pa.Schema) -> bytes:
    columns = [
        coded(table[f.name]) if pa.types.is_dictionary(f.type) else pa.array(table[f.name], f.type, from_pandas=True)
        for f in schema
    ]
    packed = pa.Table.from_arrays(columns, schema=schema)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(packed)
    return sink.getvalue().to_pybytes()


def _unpack(packed: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(packed).read_pandas()


def collected(parts: Iterator[pd.DataFrame], combine: Combine | None) -> pd.DataFrame | None:
    """A group's new rows. With ``combine`` no more than ``WAITING_ROWS`` or so are held as they came."""
    done: list[pd.DataFrame] = []
    waiting: list[pd.DataFrame] = []
    again = 2 * WAITING_ROWS
    for p in parts:
        if len(p):
            waiting.append(p)
        if combine is not None and sum(map(len, waiting)) >= WAITING_ROWS:
            done, waiting = [*done, combine(waiting)], []
            if sum(map(len, done)) >= again:
                done = [combine(done)]
                again = max(again, 2 * len(done[0]))
    if done:
        return combine([*done, *waiting])
    return pd.concat(waiting, ignore_index=True) if waiting else None


def fold_groups(
    rows: DataFrame,
    keys: Sequence[str],
    step: Step,
    output: str,
    kept: pa.Schema,
    *,
    time: str | None = None,
    horizon_ms: int = 0,
    combine: Combine | None = None,
) -> DataFrame:
    """What ``step`` emits, group by group, in append mode.

    ``rows`` must have no nulls in number columns. With ``time`` (a kept column in
    milliseconds) kept rows fall out once the watermark has passed them by ``horizon_ms``,
    also in groups without new rows; ``rows`` needs a watermark then, and what is behind it
    never arrives. Without it the state is kept for good. ``combine`` collapses equal new rows as they
    come, so a group with very many of them takes no more memory than its distinct ones.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = collected(parts, combine)
        held = _unpack(state.get[0]) if state.exists else kept.empty_table().to_pandas()
        passed = max(state.getCurrentWatermarkMs(), 0) if time is not None else 0
        arrived = new is not None
        if arrived:
            emitted, held = step(held, new, passed)
            for at in range(0, len(emitted), EMITTED_ROWS):
                yield emitted.iloc[at : at + EMITTED_ROWS]
            del emitted, new
        if time is not None:
            held = held[held[time] >= passed - horizon_ms]
            if not len(held):
                if state.exists:
                    state.remove()
                return
            state.update((_pack(held, kept),))
            due = int(held[time].min()) + horizon_ms + 1
            state.setTimeoutTimestamp(max(due, passed + 1))
        elif arrived:
            state.update((_pack(held, kept),))

    timeout = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout
    return rows.groupBy(*keys).applyInPandasWithState(run, output, "packed binary", "append", timeout)


def buckets_for(rows: int) -> int:
    """Buckets in which a micro-batch of ``rows`` is worked on in bounded memory."""
    return max(FEWEST_BUCKETS, -(-rows // ROWS_PER_BUCKET))


def partitions_for(rows: int) -> int:
    """Partitions in which the buckets of a micro-batch of ``rows`` are sorted in bounded memory."""
    return max(1, -(-rows // ROWS_PER_PARTITION))


def message_bucket(keys: Sequence[str], buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")

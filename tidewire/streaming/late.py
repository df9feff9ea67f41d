"""Rows behind the watermark, kept instead of lost."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import AtomicType, BinaryType


def mark_late(rows: DataFrame, time: str, *, lateness: str, buckets: int = 64) -> DataFrame:
    """``rows`` with ``late``: whether an event-time operator with that lateness would drop them.

    The high mark is the watermark of the query itself, so the mark is the very one that Spark's
    windows and joins go by; rows pass this operator on either side of it. Each bucket keeps only
    the number of its late rows. Rows without a time are not late. Write the result partitioned by
    ``late`` and the rest of the work can read one side and account for the other. Columns must be
    atomic; any of them may be null.
    """
    kinds = {f.name: f.dataType for f in rows.schema}
    nested = [n for n, t in kinds.items() if not isinstance(t, AtomicType)]
    if nested:
        raise ValueError(f"columns {nested} have no text form that can be read back")

    def as_text(name: str) -> Column:
        c = F.col(f"`{name}`")
        return F.base64(c) if isinstance(kinds[name], BinaryType) else c.cast("string")

    def from_text(name: str, text: str) -> Column:
        c = F.col(text)
        return F.unbase64(c).alias(name) if isinstance(kinds[name], BinaryType) else c.cast(kinds[name]).alias(name)

    # As text, since numbers with nulls would come out of a data frame as floats.
    texts = {n: f"c{i}" for i, n in enumerate(rows.columns)}
    slim = rows.withWatermark(time, lateness).select(
        F.pmod(F.xxhash64(*texts), F.lit(buckets)).cast("int").alias("bucket"),
        F.coalesce(F.unix_millis(time), F.lit(2**62)).cast("bigint").alias("ms"),
        *[as_text(n).alias(t) for n, t in texts.items()],
        F.col(time).alias("at"),
    )

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = max(state.getCurrentWatermarkMs(), 0)
        n = state.get[0] if state.exists else 0
        for p in parts:
            late = p["ms"] < passed
            n += int(late.sum())
            yield p[list(texts.values())].assign(late=late)
        state.update((n,))

    output = ", ".join([f"{t} string" for t in texts.values()] + ["late boolean"])
    out = slim.groupBy("bucket").applyInPandasWithState(
        run, output, "n_late bigint", "append", GroupStateTimeout.NoTimeout
    )
    return out.select(*[from_text(n, t) for n, t in texts.items()], "late")

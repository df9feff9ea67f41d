"""Byte-bounded batches of a stream: a publisher's carried bytes are its state."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators.microbatch import _next_close
from tidewire.streaming.kept import fold_groups

#: The open batch of a key: its number, rows, bytes and first time.
_KEPT = pa.schema([(c, pa.int64()) for c in ("batch_id", "n_rows", "n_bytes", "first_us")])


def _closing_rows(size: np.ndarray, forced: np.ndarray, limit: int, held: int) -> list[int]:
    """Places of the rows that close a batch, with ``held`` bytes carried into the first."""
    cum = np.cumsum(size)
    following = _next_close(cum, forced, limit)
    certain = (cum + held >= limit) | forced
    at = int(np.argmax(certain)) if certain.any() else len(cum)
    closes = []
    while at < len(cum):
        closes.append(at)
        at = int(following[at])
    return closes


def stream_batches(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, limit: int, forced: Column
) -> DataFrame:
    """Number, rows, bytes, first and last time of every batch as it closes.

    A batch closes at the row that brings it to ``limit`` bytes or that is ``forced`` (the closing
    message of a publisher). ``order`` starts with a time in microseconds; rows of a key are put in
    order within a micro-batch, and later micro-batches must hold later rows of the key, as a
    publisher sends them. The open batch is one state row per key; it stays open until more rows
    arrive. Keys must not be null, sizes neither.
    """
    keys, order = list(keys), list(order)
    kinds = dict(rows.dtypes)

    def step(kept: pd.DataFrame, new: pd.DataFrame, watermark_ms: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        new = new.sort_values(order, kind="stable")
        at, sizes = new[order[0]].to_numpy(), new[size].to_numpy()
        number, n, held, first = kept.iloc[0].tolist() if len(kept) else (0, 0, 0, int(at[0]))
        closes = _closing_rows(sizes, new["_forced"].to_numpy(), limit, held)
        out, begin = [], 0
        for end in closes:
            total = held + int(sizes[begin : end + 1].sum())
            out.append((number, n + end + 1 - begin, total, first if n else int(at[begin]), int(at[end])))
            number, n, held, begin = number + 1, 0, 0, end + 1
        left = len(sizes) - begin
        if left and not n:
            first = int(at[begin])
        held += int(sizes[begin:].sum())
        made = pd.DataFrame(out, columns=["batch_id", "n_rows", "n_bytes", "first_us", "published_us"])
        for k in keys:
            made[k] = new[k].iloc[0]
        return made, pd.DataFrame([(number, n + left, held, first)], columns=_KEPT.names)

    slim = rows.select(*keys, *order, size, F.coalesce(forced, F.lit(False)).alias("_forced"))
    output = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [f"{c} bigint" for c in (*_KEPT.names, "published_us")])
    return fold_groups(slim, keys, step, output, _KEPT)

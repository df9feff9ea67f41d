"""All latency segments of an event stream from one keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.stage_pairs import E2E_DECODED, E2E_RECEIVED, settle_end_to_end
from tidewire.schemas import (
    DESERIALIZED,
    MESSAGE,
    PUB_TO_REC,
    PUBLICATION,
    REC_TO_DES,
    RECEPTION,
    RUN,
    SER_TO_PUB,
    SERIALIZING,
)
from tidewire.streaming.kept import FEWEST_BUCKETS, coded, fold_groups, message_bucket

_HERE = [*MESSAGE, "container_name"]
_SEGMENTS = [
    (SER_TO_PUB, SERIALIZING, PUBLICATION, _HERE),
    (PUB_TO_REC, PUBLICATION, RECEPTION, MESSAGE),
    (REC_TO_DES, RECEPTION, DESERIALIZED, _HERE),
    (E2E_DECODED, SERIALIZING, DESERIALIZED, MESSAGE),
    (E2E_RECEIVED, SERIALIZING, RECEPTION, MESSAGE),
]
_TEXTS = [*_HERE, "event_type"]
_KEPT = pa.schema(
    [(c, pa.dictionary(pa.int32(), pa.string())) for c in _TEXTS] + [("ms", pa.int64()), ("n", pa.int64())]
)
_TIME = ["t0_ms", "latency_ms"]
OUTPUT = (
    "scenario string, tech string, run string, segment string, t0_ms bigint, "
    "latency_ms bigint, weight bigint"
)
#: Pairs that are worked on at once.
_PAIRS = 1 << 18


def _numbered(*columns: np.ndarray) -> np.ndarray:
    """A number for every combination, in the order of the combinations; columns begin at -1."""
    out, span = columns[0].astype("int64"), int(columns[0].max(initial=0)) + 2
    for c in columns[1:]:
        width = int(c.max(initial=0)) + 2
        if span * width >= 2**62:
            out = np.unique(out, return_inverse=True)[1]
            span = len(out) + 1
        out, span = (out + 1) * width + c, (span + 1) * width
    return out


class _Rows:
    """Distinct rows of some tables, ordered by message, container, stage and time.

    ``n`` has for each row its number in every table.
    """

    def __init__(self, tables: list[pd.DataFrame]):
        codes, self.texts = {}, {}
        for c in _TEXTS:
            parts = pa.chunked_array([coded(t[c]) for t in tables]).unify_dictionaries().chunks
            codes[c] = np.concatenate([p.indices.fill_null(-1).to_numpy(zero_copy_only=False) for p in parts])
            self.texts[c] = parts[0].dictionary
        ms = np.concatenate([t["ms"].to_numpy("int64") for t in tables])
        message = _numbered(*[codes[c] for c in ("message_id", *RUN, "topic")])
        here = _numbered(message, codes["container_name"])
        row = _numbered(here, codes["event_type"])
        order = np.lexsort((ms, row))
        row, ms = row[order], ms[order]
        first = np.ones(len(order), bool)
        first[1:] = (row[1:] != row[:-1]) | (ms[1:] != ms[:-1])
        begin = np.flatnonzero(first)
        own = np.repeat(np.arange(len(tables)), [len(t) for t in tables])[order]
        n = np.concatenate([t["n"].to_numpy("int64") for t in tables])[order]
        self.n = [np.add.reduceat(np.where(own == k, n, 0), begin) if len(begin) else n for k in range(len(tables))]
        order = order[begin]
        self.codes = {c: v[order] for c, v in codes.items()}
        self.ms, self.message, self.here = ms[begin], message[order], here[order]

    def table(self) -> pd.DataFrame:
        texts = {
            c: pd.Categorical.from_codes(self.codes[c], self.texts[c].to_pandas(), validate=False) for c in _TEXTS
        }
        return pd.DataFrame(texts | {"ms": self.ms, "n": sum(self.n)})

    def of(self, stage: str) -> np.ndarray:
        at = pc.index(self.texts["event_type"], stage).as_py()
        return np.flatnonzero(self.codes["event_type"] == at) if at >= 0 else np.empty(0, "int64")


def combine_rows(parts: list[pd.DataFrame]) -> pd.DataFrame:
    """Equal rows as one row with their number."""
    return _Rows([p[_KEPT.names] for p in parts]).table()


def _met(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``a`` and ``b`` with the same key, some ``_PAIRS`` at a time; ``key`` ascends."""
    if not len(a) or not len(b):
        return
    begin = np.searchsorted(key[b], key[a], "left")
    counts = np.searchsorted(key[b], key[a], "right") - begin
    ends = np.cumsum(counts)
    at = 0
    while at < len(a):
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + _PAIRS, "right")))
        c = counts[at:to]
        within = np.arange(int(ends[to - 1]) - done) - np.repeat(ends[at:to] - c - done, c)
        if len(within):
            yield np.repeat(a[at:to], c), b[np.repeat(begin[at:to], c) + within]
        at = to


def _summed(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Equal (run and segment, start, latency) as one row with the sum of their weights."""
    what, t0, latency, weight = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((latency, t0, what))
    what, t0, latency, weight = (x[order] for x in (what, t0, latency, weight))
    first = np.ones(len(order), bool)
    first[1:] = (what[1:] != what[:-1]) | (t0[1:] != t0[:-1]) | (latency[1:] != latency[:-1])
    begin = np.flatnonzero(first)
    return what[begin], t0[begin], latency[begin], np.add.reduceat(weight, begin)


def pair_step(
    kept: pd.DataFrame, new: pd.DataFrame, watermark_ms: int
) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Pairs with at least one new row; equal rows are one row with their number."""
    rows = _Rows([kept[_KEPT.names], new[_KEPT.names]])
    n_kept, n_new = rows.n
    codes = [rows.codes[c] for c in RUN]
    _, run_at, run = np.unique(_numbered(*codes), return_index=True, return_inverse=True)
    named = np.logical_and.reduce([c >= 0 for c in codes])
    found: list[tuple[np.ndarray, ...]] = []
    for k, (_, first, last, on) in enumerate(_SEGMENTS):
        a, b = rows.of(first), rows.of(last)
        a = a[named[a]]
        if on is _HERE:
            a = a[rows.codes["container_name"][a] >= 0]
        key = rows.here if on is _HERE else rows.message
        for n_a, n_b, a_in, b_in in (
            (n_new, n_kept + n_new, a[n_new[a] > 0], b),
            (n_kept, n_new, a[n_kept[a] > 0], b[n_new[b] > 0]),
        ):
            for x, y in _met(a_in, b_in, key):
                latency = np.maximum(rows.ms[y] - rows.ms[x], 0)
                found.append((run[x] * len(_SEGMENTS) + k, rows.ms[x], latency, n_a[x] * n_b[y]))
                if sum(len(f[0]) for f in found[1:]) >= max(_PAIRS, len(found[0][0])):
                    found = [_summed(found)]
    if not found:
        return pd.DataFrame(columns=[*RUN, "segment", *_TIME, "weight"]), rows.table()
    what, t0, latency, weight = _summed(found)
    at, segment = run_at[what // len(_SEGMENTS)], np.array([s[0] for s in _SEGMENTS], object)
    texts = {c: rows.texts[c].to_numpy(zero_copy_only=False)[rows.codes[c][at]] for c in RUN}
    out = {"segment": segment[what % len(_SEGMENTS)], "t0_ms": t0, "latency_ms": latency, "weight": weight}
    return pd.DataFrame(texts | out), rows.table()


def stream_segments(
    events: DataFrame, *, lateness: str, horizon_ms: int, buckets: int = FEWEST_BUCKETS
) -> DataFrame:
    """(run keys, segment, t0_ms, latency_ms, weight) as the stages of messages arrive.

    A message's starts meet every consumer's ends whichever comes first. Both end-to-end forms
    are emitted, as only the whole run tells which one holds (``settle_segments``). Weights are
    additive. Two stages meet if neither is more than ``horizon_ms`` behind the watermark when
    the other arrives; rows later than ``lateness`` are not seen. Rows without a topic have no
    partner. A bucket's rows are worked on at once, so ``buckets`` is to follow the rows of a
    micro-batch (``buckets_for``).
    """
    rows = (
        events.withWatermark("timestamp", lateness)
        .filter(F.col("topic").isNotNull() & F.col("timestamp").isNotNull())
        .select(
            message_bucket(MESSAGE, buckets),
            *_HERE,
            "event_type",
            "timestamp",
            F.unix_millis("timestamp").alias("ms"),
            F.lit(1).cast("bigint").alias("n"),
        )
    )
    return fold_groups(
        rows, ["bucket"], pair_step, OUTPUT, _KEPT, time="ms", horizon_ms=horizon_ms, combine=combine_rows
    )


def stream_bounds(events: DataFrame) -> DataFrame:
    """Run start and whether anything was decoded so far; one state row per run."""
    return events.groupBy(*RUN).agg(
        F.unix_millis(F.min("timestamp")).alias("start_ms"),
        F.max(F.col("event_type") == DESERIALIZED).alias("has_deserialized"),
    )


def settle_segments(pairs: DataFrame, bounds: DataFrame) -> DataFrame:
    """Stored pairs as (segment, start second of the run, latency) with their number."""
    timed = pairs.join(bounds.select(*RUN, "start_ms"), RUN).withColumn(
        "time_s", F.floor((F.col("t0_ms") - F.col("start_ms")) / 1000).cast("bigint")
    )
    summed = timed.groupBy(*RUN, "segment", "time_s", "latency_ms").agg(F.sum("weight").alias("weight"))
    return settle_end_to_end(summed, bounds)

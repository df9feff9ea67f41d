"""Latency segments against the plain joins, with copies and redeliveries."""

from __future__ import annotations

import math
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire import session
from tidewire.operators.rank_select import histogram_quantiles
from tidewire.plans.latency import latency_stats, latency_trimmed, segment_samples
from tidewire.schemas import RUN

T0 = datetime(2024, 1, 1)
SCHEMA = (
    "scenario string, tech string, run string, message_id string, topic string, "
    "container_name string, event_type string, timestamp timestamp"
)


def make_events(seed: int, decoded: bool, n: int = 40):
    rnd = random.Random(seed)
    rows = []

    def add(run, mid, topic, container, kind, ms):
        rows.append(("s", "t", run, mid, topic, container, kind, T0 + timedelta(milliseconds=ms)))

    for run in ("r0", "r1"):
        for i in range(n):
            mid, topic, at = f"P0-{i}", rnd.choice(["a", "b", None]), rnd.randrange(20000) + 0.5
            add(run, mid, topic, "t-P0", "Serializing", at)
            copies = rnd.choice([1, 1, 1, 3])
            for _ in range(copies):
                add(run, mid, topic, "t-P0" if rnd.random() < 0.9 else None, "Publication", at + 7)
            for c in ("t-C0", "t-C1"):
                for _ in range(rnd.choice([0, 1, 1, 2])):
                    late = at + rnd.randrange(-5, 300)
                    add(run, mid, topic, c, "Reception", late)
                    if decoded and run == "r0" and rnd.random() < 0.8:
                        add(run, mid, topic, c, "Deserialized", late + rnd.randrange(9))
    rnd.shuffle(rows)
    return rows


def ms(ts):
    return math.floor((ts - T0) / timedelta(microseconds=1) / 1000)


def brute_samples(rows):
    out = []
    by_run = defaultdict(list)
    for r in rows:
        by_run[r[:3]].append(r)
    for run, evs in by_run.items():
        has = any(e[6] == "Deserialized" for e in evs)
        start = min(ms(e[7]) for e in evs)
        specs = [
            ("Serializing", "Publication", True, "serializing_to_publication"),
            ("Publication", "Reception", False, "publication_to_reception"),
            ("Serializing", "Deserialized" if has else "Reception", False, "end_to_end"),
        ]
        if has:
            specs.append(("Reception", "Deserialized", True, "reception_to_deserialized"))
        for a, b, same, seg in specs:
            for x in evs:
                if x[6] != a or x[4] is None or (same and x[5] is None):
                    continue
                for y in evs:
                    if y[6] == b and x[3:5] == y[3:5] and (not same or x[5] == y[5]):
                        lat = max(ms(y[7]) - ms(x[7]), 0)
                        out.append((*run, seg, (ms(x[7]) - start) // 1000, lat))
    return out


def pick(values, q):
    values = sorted(values)
    return float(values[math.floor((len(values) - 1) * q + 0.5)])


def brute_stats(samples):
    groups = defaultdict(list)
    for *key, _, lat in samples:
        groups[tuple(key)].append(lat)
    return {
        k: (pick(v, 0.5), pick(v, 0.9), pick(v, 0.99), float(max(v))) for k, v in groups.items()
    }


@pytest.mark.parametrize("seed,decoded", [(1, True), (2, False)])
def test_samples_and_stats_equal_plain_joins(spark, seed, decoded):
    rows = make_events(seed, decoded)
    df = spark.createDataFrame(rows, SCHEMA)
    want = defaultdict(int)
    for s in brute_samples(rows):
        want[s] += 1
    got = {
        (*[r[k] for k in RUN], r["segment"], r["time_s"], r["latency_ms"]): r["weight"]
        for r in segment_samples(df).collect()
    }
    assert got == dict(want)
    stats = {
        (*[r[k] for k in RUN], r["segment"]): (r["p50_ms"], r["p90_ms"], r["p99_ms"], r["max_ms"])
        for r in latency_stats(df).collect()
    }
    assert {k: v for k, v in stats.items() if v[0] is not None} == brute_stats(brute_samples(rows))


def test_trimmed_uses_latest_start_of_the_run(spark):
    rows = make_events(3, True)
    samples = brute_samples(rows)
    last = defaultdict(int)
    for s in samples:
        last[s[:3]] = max(last[s[:3]], s[4])
    want = brute_stats([s for s in samples if 4 <= s[4] <= last[s[:3]] - 6])
    got = {
        (*[r[k] for k in RUN], r["segment"]): (r["p50_ms"], r["p90_ms"], r["p99_ms"], r["max_ms"])
        for r in latency_trimmed(spark.createDataFrame(rows, SCHEMA), 4, 6).collect()
    }
    assert got == want


def test_segment_without_samples(spark):
    """Untrimmed gives a row of nulls, trimmed gives no row."""
    rows = [
        ("s", "t", "r", "P0-1", "a", "t-P0", "Serializing", T0),
        ("s", "t", "r", "P0-1", "a", "t-P0", "Publication", T0 + timedelta(seconds=1)),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    full = {r["segment"]: r["p50_ms"] for r in latency_stats(df).collect()}
    assert full == {
        "serializing_to_publication": 1000.0,
        "publication_to_reception": None,
        "end_to_end": None,
    }
    trimmed = [r["segment"] for r in latency_trimmed(df, 0, 0).collect()]
    assert len(trimmed) == 3
    assert latency_trimmed(df, 1, 0).collect() == []


def test_hot_message_of_exact_copies(spark):
    """A million pairs of copies stay two compact rows and one weight."""
    rows = [("s", "t", "r", "P0-1", "a", "t-P0", "Publication", T0)] * 1000
    rows += [("s", "t", "r", "P0-1", "a", "t-C0", "Reception", T0 + timedelta(milliseconds=5))] * 1000
    got = segment_samples(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["segment"], r["latency_ms"], r["weight"]) for r in got] == [
        ("publication_to_reception", 5, 1_000_000)
    ]


def _written(spark, root, label):
    """Rows of every file of the step ``label``, the only one under ``root``."""
    (folder,) = root.glob(f"{label}-*")
    rows = spark.read.parquet(str(folder)).groupBy(F.input_file_name()).count().collect()
    return [r["count"] for r in rows]


@pytest.mark.parametrize("plan", [segment_samples, latency_stats])
def test_tasks_are_bounded_whatever_the_shuffle_partitions(spark, monkeypatch, tmp_path, plan):
    monkeypatch.setattr(session, "scratch_root", lambda _: str(tmp_path))
    monkeypatch.setattr(session, "TASK_BYTES", 16 << 10)
    least = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    own = {least: "1k", "spark.sql.shuffle.partitions": "1", session._ADVISORY: "32m"}
    before = {k: spark.conf.get(k) for k in own}
    at = "timestamp_millis(1704067200000 + id * 7 + {})"
    stage = "named_struct('container_name', '{}', 'event_type', '{}', 'timestamp', " + at + ")"
    stages = [("t-P0", "Serializing", 0), ("t-P0", "Publication", "id % 5"), ("t-C0", "Reception", "id % 97")]
    log = spark.range(20000).selectExpr(
        "'s' AS scenario", "'t' AS tech", "'r' AS run", "concat('P0-', id) AS message_id", "'a' AS topic",
        f"inline(array({', '.join(stage.format(*x) for x in stages)}))",
    )
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        got = plan(log).collect()
        assert {k: spark.conf.get(k) for k in own} == own
        assert spark.conf.get(session._INITIAL, None) is None
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    if plan is segment_samples:
        assert sum(r["weight"] for r in got) == 60000
    rows = _written(spark, tmp_path, "message-stages")
    assert sum(rows) == 40000 and len(rows) > 8 and max(rows) < 10000


def test_small_tasks_inside_each_other(spark):
    keys = (session._ADVISORY, session._INITIAL, session._SPLIT)
    before = [spark.conf.get(k, None) for k in keys]
    with session.small_tasks(spark):
        with session.small_tasks(spark):
            pass
        assert session._bytes(spark.conf.get(session._ADVISORY)) == session.TASK_BYTES
        assert session._bytes(spark.conf.get(session._SPLIT)) == 2 * session.TASK_BYTES
        assert int(spark.conf.get(session._INITIAL)) == session.FINEST
    assert [spark.conf.get(k, None) for k in keys] == before
    assert [session._bytes(x) for x in ("5", "8m", "64MB", "16777216b", "2g")] == [
        5, 8 << 20, 64 << 20, 16 << 20, 2 << 30,
    ]


def test_only_scattered_containers_are_read_again(spark, monkeypatch, tmp_path):
    """The other containers of a redelivered message keep their one row."""
    monkeypatch.setattr(session, "scratch_root", lambda _: str(tmp_path))
    rows = [
        ("s", "t", "r", "P0-1", "a", who, kind, T0 + timedelta(milliseconds=ms))
        for who, kind, ms in (
            ("t-P0", "Serializing", 0),
            ("t-P0", "Publication", 2),
            ("t-C0", "Reception", 5),
            ("t-C0", "Reception", 255),
            ("t-C0", "Deserialized", 9),
            ("t-C1", "Reception", 6),
            ("t-C1", "Reception", 6),
            (None, "Reception", 7),
            (None, "Reception", 8),
        )
    ]
    want = defaultdict(int)
    for x in brute_samples(rows):
        want[x] += 1
    got = segment_samples(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(*[r[k] for k in RUN], r["segment"], r["time_s"], r["latency_ms"]): r["weight"] for r in got} == dict(want)
    # Two receptions and one decoding of C0, two receptions without a container.
    assert sum(_written(spark, tmp_path, "scattered-stages")) == 5


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_histogram_quantiles_equal_sort_and_index(spark, block):
    rnd = random.Random(block)
    hist, want = [], {}
    for key in range(12):
        counts = {rnd.randrange(40): rnd.randrange(1, 6) for _ in range(rnd.randrange(1, 9))}
        flat = [v for v, n in counts.items() for _ in range(n)]
        want[key] = (pick(flat, 0.5), pick(flat, 0.9), pick(flat, 0.99), float(max(flat)))
        hist += [(key, v, n) for v, n in counts.items()]
    df = spark.createDataFrame(hist, "k int, v bigint, n bigint")
    out = histogram_quantiles(
        df, ["k"], "v", "n", {"a": 0.5, "b": 0.9, "c": 0.99}, "top", block
    ).collect()
    assert {r["k"]: (r["a"], r["b"], r["c"], r["top"]) for r in out} == want

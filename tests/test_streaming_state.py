"""State steps against brute force over all rows, and streams whose state falls out."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewire.operators.microbatch import assign_batches, summarise_batches
from tidewire.streaming import completion, segments, size_fill
from tidewire.streaming.late import mark_late
from tidewire.streaming.microbatch import stream_batches

STAGES = ("Serializing", "Publication", "Reception", "Deserialized")


def in_parts(rng, rows, n):
    """The rows shuffled and cut into up to n non-empty parts."""
    rows = rows[:]
    rng.shuffle(rows)
    cuts = sorted(rng.sample(range(1, len(rows)), min(n, len(rows)) - 1))
    return [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]


def run_steps(step, schema, parts, columns):
    kept, out = schema.empty_table().to_pandas(), []
    for part in parts:
        made, kept = step(kept, pd.DataFrame(part, columns=columns), 0)
        out.append(made)
    return pd.concat([o for o in out if len(o)] or out[:1], ignore_index=True)


@pytest.mark.parametrize("seed", range(6))
def test_sizes_meet_in_any_order(seed):
    rng = random.Random(seed)
    log = []
    for m in range(8):
        for _ in range(rng.randrange(1, 9)):
            stage = rng.choice(STAGES)
            size = None if stage == "Serializing" else rng.choice((None, 100 + m, 50, 2**60 + 1))
            log.append((f"r{m % 2}", f"m{m}", stage, rng.randrange(4), size))
    want = Counter()
    for run, m, stage, second, size in log:
        if size is not None:
            continue
        known = {s: [z for r, x, t, _, z in log if (r, x, t) == (run, m, s) and z is not None] for s in STAGES}
        published, decoded = (min(known[s], default=None) for s in ("Publication", "Deserialized"))
        found = {"Serializing": published, "Reception": decoded}.get(stage, decoded if published is None else published)
        if found is not None:
            want[run, stage, second, "bytes"] += found
            want[run, stage, second, "n"] += 1
    columns = ["scenario", "tech", *("run", "message_id", "topic", "event_type", "kind", "second", "size", "n", "ms")]
    rows = []
    for run, m, stage, second, size in log:
        if size is None:
            rows.append(("s", "t", run, m, "a", stage, 2, second, size_fill._UNKNOWN, 1, second * 1000))
        elif stage in ("Publication", "Deserialized"):
            rows.append(("s", "t", run, m, "a", stage, int(stage == "Deserialized"), second, size, 1, second * 1000))
    if not rows:
        return
    out = run_steps(size_fill.fill_step, size_fill._KEPT, in_parts(rng, rows, rng.randrange(1, 7)), columns)
    got = Counter()
    for r in out.itertuples():
        got[r.run, r.event_type, r.second, "bytes"] += r.bytes
        got[r.run, r.event_type, r.second, "n"] += r.sized
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("seed", range(6))
def test_segments_of_scattered_and_copied_messages(seed):
    rng = random.Random(seed)
    log = []
    for _ in range(60):
        container = rng.choice(("t-P0", "t-C0", "t-C1", None))
        log.append((f"m{rng.randrange(5)}", container, rng.choice(STAGES), rng.randrange(6)))
    want = Counter()
    for segment, first, last, on in segments._SEGMENTS:
        for m, c, stage, t in log:
            for m2, c2, stage2, t2 in log:
                same = m == m2 and (on is not segments._HERE or (c is not None and c == c2))
                if stage == first and stage2 == last and same:
                    want[segment, t, max(t2 - t, 0)] += 1
    columns = [*segments._HERE, "event_type", "ms", "n"]
    rows = [("s", "t", "r", m, "a", c, stage, t, 1) for m, c, stage, t in log]
    out = run_steps(segments.pair_step, segments._KEPT, in_parts(rng, rows, rng.randrange(1, 9)), columns)
    got = Counter()
    for r in out.itertuples():
        got[r.segment, r.t0_ms, r.latency_ms] += r.weight
    assert got == want


@pytest.mark.parametrize("seed", range(4))
def test_countdown_ends_at_the_nth_time(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 5)
    rows = [("s", "t", "r", "c", rng.choice(STAGES[2:]), rng.randrange(20), n) for _ in range(14)]
    columns = ["scenario", "tech", "run", "container_name", "event_type", "us", "n_subscribed"]
    out = run_steps(completion.countdown_step, completion._KEPT, in_parts(rng, rows, 6), columns)
    got = out.groupby("event_type")["completed_us"].min().to_dict() if len(out) else {}
    want = {}
    for stage in STAGES[2:]:
        times = sorted(r[5] for r in rows if r[4] == stage)
        if len(times) >= n:
            want[stage] = times[n - 1]
    assert got == want
    in_order = [[r] for r in sorted(rows, key=lambda r: r[5])]
    once = run_steps(completion.countdown_step, completion._KEPT, in_order, columns)
    assert len(once) == len(want)


EVENTS = (
    "scenario string, tech string, run string, message_id string, topic string, container_name string, "
    "event_type string, serialized_size bigint, timestamp timestamp"
)
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def files(spark, folder, parts, schema):
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(folder / f"p{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))


def drained(stream, tmp_path):
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "cp")
    ).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def event(m, stage, container, size, second, topic="a"):
    return ("s", "t", "r", m, topic, container, stage, size, T0 + timedelta(seconds=second))


def test_a_size_after_the_horizon_is_not_given(spark, tmp_path):
    parts = [
        [event("m1", "Reception", "c", None, 1), event("m2", "Reception", "c", None, 1),
         event("m3", "Reception", "c", None, 2, None)],
        [event("m1", "Deserialized", "c", 10, 3), event("far", "Serializing", "p", None, 100)],
        [event("x", "Serializing", "p", None, 101)],
        [event("m2", "Deserialized", "c", 20, 99)],
    ]
    stream = files(spark, tmp_path / "in", parts, EVENTS)
    found = drained(size_fill.filled_sizes(stream, lateness="5 seconds", horizon_ms=20_000, buckets=3), tmp_path)
    at = int(T0.timestamp()) + 1
    assert [(r["event_type"], r["second"], r["bytes"], r["sized"]) for r in found.collect()] == [("Reception", at, 10, 1)]


def test_pairs_over_files_and_the_end_stage_of_a_run(spark, tmp_path):
    parts = [
        [event("m1", "Reception", "c", None, 2), event("m1", "Serializing", "p", None, 0)],
        [event("m1", "Publication", "p", 5, 1), event("m1", "Reception", "d", None, 4)],
    ]
    stream = files(spark, tmp_path / "in", parts, EVENTS)
    pairs = drained(segments.stream_segments(stream, lateness="9 seconds", horizon_ms=9000, buckets=3), tmp_path)
    bounds = segments.stream_bounds(spark.createDataFrame(sum(parts, []), EVENTS))
    got = segments.settle_segments(pairs, bounds).collect()
    assert sorted((r["segment"], r["time_s"], r["latency_ms"], r["weight"]) for r in got) == [
        ("end_to_end", 0, 2000, 1), ("end_to_end", 0, 4000, 1),
        ("publication_to_reception", 1, 1000, 1), ("publication_to_reception", 1, 3000, 1),
        ("serializing_to_publication", 0, 1000, 1),
    ]


def test_streamed_batches_equal_the_batch_form(spark, tmp_path):
    rng = random.Random(3)
    rows = [
        (f"p{k % 3}", k, 10 * k + k % 7, rng.choice((0, 5, 40, 300)), rng.random() < 0.1) for k in range(300)
    ]
    schema = "p string, id bigint, us bigint, sz bigint, last boolean"
    parts = [rows[:1], rows[1:70], rows[70:71], rows[71:200], rows[200:]]
    stream = files(spark, tmp_path / "in", parts, schema)
    got = drained(stream_batches(stream, ["p"], ["us", "id"], "sz", 400, F.col("last")), tmp_path)
    df = spark.createDataFrame(rows, schema)
    assigned = assign_batches(df, ["p"], ["us", "id"], "sz", 400, F.col("last"))
    want = summarise_batches(assigned, ["p"], "us", "sz").collect()
    # The last batch of a publisher may still be open.
    newest = {}
    for r in want:
        newest[r["p"]] = max(newest.get(r["p"], -1), r["batch_id"])
    columns = ["p", "batch_id", "n_rows", "n_bytes", "first_us", "published_us"]
    made = {tuple(r[c] for c in columns) for r in got.collect()}
    closed = {tuple(r[c] for c in columns) for r in want}
    assert made <= closed and all(r["batch_id"] == newest[r["p"]] for r in want if tuple(r[c] for c in columns) not in made)
    assert len(made) > 20


def test_late_rows_are_kept_whole(spark, tmp_path):
    def row(k, second):
        return (k, None if second is None else T0 + timedelta(seconds=second, microseconds=7), 2**60 + 1 if k % 2 else None, b"\xff\x00", "é" if k % 3 else None)

    schema = "k int, at timestamp, big bigint, raw binary, name string"
    parts = [[row(1, 0), row(2, 50)], [row(3, 45), row(4, 39), row(5, None), row(6, 70)], [row(7, 59), row(8, 60)]]
    stream = files(spark, tmp_path / "in", parts, schema)
    got = drained(mark_late(stream, "at", lateness="10 seconds", buckets=4), tmp_path)
    rows = sum(parts, [])
    assert sorted(r["k"] for r in got.where("late").collect()) == [4, 7]
    assert sorted(map(str, got.drop("late").collect())) == sorted(map(str, spark.createDataFrame(rows, schema).collect()))
    with pytest.raises(ValueError):
        mark_late(spark.createDataFrame([], "at timestamp, x array<int>"), "at", lateness="1 second")

"""Metric store reuse and streaming against batch."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewire.plans.messages import closing_events, stream_completion, workload
from tidewire.plans.store import load_or_compute, metric_path, write_client_documents
from tidewire.plans.throughput import curve_from_buckets, throughput
from tidewire.schemas import RUN
from tidewire.session import materialise, scratch_root
from tidewire.streaming.completion import closing_counts, remaining_streams
from tidewire.streaming.throughput import drain_buckets, read_buckets, stream_buckets

SCHEMA = "time_s bigint, throughput_mb_s double, scenario string, tech string, run string"


def test_store_computes_only_what_is_missing_or_invalid(spark, tmp_path):
    path = metric_path(str(tmp_path), "throughput", window_s=10, event="publication")
    assert path.endswith("throughput/event=publication/window_s=10")
    asked = []

    def compute(missing, first=0):
        runs = sorted(r["run"] for r in missing.collect())
        asked.append(runs)
        points = [(t, float(t), "s", "t", r) for r in runs for t in range(first, 3)]
        return spark.createDataFrame(points, SCHEMA)

    runs = lambda *names: spark.createDataFrame([("s", "t", n) for n in names], "scenario string, tech string, run string")
    load_or_compute(spark, path, SCHEMA, runs("01"), lambda m: compute(m, -1))
    assert load_or_compute(spark, path, SCHEMA, runs("01", "2"), compute).count() == 6
    assert load_or_compute(spark, path, SCHEMA, runs("2"), compute).count() == 3
    # The first result began before zero, so it was computed again.
    assert asked == [["01"], ["01", "2"]]


def test_client_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "P0", '{"a":1}')], "scenario_id bigint, client_id string, document string")
    write_client_documents(docs, str(tmp_path / "c"), "scenario_id")
    assert spark.read.text(str(tmp_path / "c")).first()["value"] == '{"a":1}'


def test_intermediate_tables_lie_in_the_scratch_folder(spark):
    root = scratch_root(spark)
    copy = materialise(spark.range(3), "x")
    assert copy.count() == 3
    assert all(f"{root}/x-" in f for f in copy.inputFiles())


def event_rows(n=200):
    t0 = datetime(2024, 1, 1)
    return [
        ("s", "t", f"r{i % 2}", f"P0-{i}", "a", "t-P0", kind, 100 + i if kind == "Publication" else None,
         t0 + timedelta(milliseconds=97 * i + lag))
        for i in range(n)
        for kind, lag in (("Serializing", 0), ("Publication", 5))
    ]


EVENTS = (
    "scenario string, tech string, run string, message_id string, topic string, container_name string, "
    "event_type string, serialized_size bigint, timestamp timestamp"
)


def test_streamed_buckets_equal_batch_over_several_micro_batches(spark, tmp_path):
    rows = event_rows()
    for i in range(4):
        part = rows[i * 100 : (i + 1) * 100]
        spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = (
        spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    )
    drain_buckets(stream_buckets(stream, lateness="1 minute"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert len(list((tmp_path / "out").iterdir())) >= 4
    got = curve_from_buckets(read_buckets(spark, str(tmp_path / "out")), 3, ["Publication"])
    want = throughput(spark.createDataFrame(rows, EVENTS), 3, ["Publication"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_completion_counts_down_to_zero(spark):
    def row(kind, mid, topic, us, run="r"):
        return ("s", "t", run, "t-C0", kind, mid, topic, us)

    schema = (
        "scenario string, tech string, run string, container_name string, event_type string, "
        "message_id string, topic string, us bigint"
    )
    rows = [
        row("Deserialized", "P0:__END__", "a", 30),
        row("Reception", "P0:__END__", "a", 1),
        row("Deserialized", "P0:__END__", "b", 10),
        row("Deserialized", "P1:__END__", "a", 20),
        row("Deserialized", "P1:__END__", "x", 5),
        row("Deserialized", "P1-3", "a", 2),
        row("Reception", "P0:__END__", "a", 7, run="plain"),
    ]
    df = spark.createDataFrame(rows, schema)
    subs = spark.createDataFrame(
        [("s", "t", "r", "t-C0", "a", 1), ("s", "t", "r", "t-C0", "b", 1),
         ("s", "t", "plain", "t-C0", "a", 2), ("s", "t", "none", "t-C0", "a", 1)],
        "scenario string, tech string, run string, container_name string, topic string, streams int",
    )
    got = {
        r["run"]: (r["n_subscribed"], r["n_seen"], r["completed_us"])
        for r in stream_completion(closing_events(df), subs, slice_us=7).collect()
    }
    assert got == {"r": (2, 3, 20), "plain": (2, 1, None), "none": (1, 0, None)}
    expected = subs.groupBy(*RUN, "container_name").agg(F.sum("streams").alias("n_subscribed"))
    left = {r["run"]: r["remaining"] for r in remaining_streams(closing_counts(df, subs), expected).collect()}
    assert left == {"r": 0, "plain": 1, "none": 1}


def test_workload_chunks_do_not_change_the_messages(spark):
    pubs = spark.createDataFrame(
        [(1, "P0", ["0", "1"], 25), (2, "P1", ["0"], 0)],
        "scenario_id bigint, pub_id string, topics array<string>, n_messages bigint",
    )
    small, large = (
        sorted(map(tuple, workload(pubs, chunk=c).collect())) for c in (4, 1000)
    )
    assert small == large and len(small) == 50
    assert {r[2] for r in small} == set(range(1, 26))
    assert {r[4] for r in small} == set(range(5))
    far = spark.createDataFrame(
        [(1, "P0", ["0"], 3)], "scenario_id bigint, pub_id string, topics array<string>, n_messages bigint"
    )
    last = [r["sample"] for r in workload(far, first_seq=9_000_000_000).collect()]
    assert len(last) == 3 and set(last) <= set(range(5))
    timed = workload(pubs, chunk=4, first_seq=0).select("seq").distinct().collect()
    assert {r["seq"] for r in timed} == set(range(25))

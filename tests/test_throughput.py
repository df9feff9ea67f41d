"""Size fill and throughput rules."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewire.operators.size_fill import fill_sizes
from tidewire.plans.curves import average_curve, curve_quality
from tidewire.plans.throughput import (
    mean_throughput_table,
    throughput,
    throughput_display,
    trim_throughput,
)
from tidewire.schemas import RUN

T0 = datetime(2024, 1, 1, 0, 0, 0, 400_000)
SCHEMA = (
    "scenario string, tech string, run string, message_id string, topic string, "
    "container_name string, event_type string, serialized_size bigint, timestamp timestamp"
)


def row(kind, size, at_s=0.0, mid="P0-1", topic="a", run="r"):
    return ("s", "t", run, mid, topic, "c", kind, size, T0 + timedelta(seconds=at_s))


def test_size_fill_rule(spark):
    rows = [
        row("Serializing", None, mid="m1"),
        row("Publication", 10, mid="m1"),
        row("Reception", None, mid="m1"),
        row("Deserialized", 20, mid="m1"),
        row("Serializing", None, mid="m2"),
        row("Deserialized", 30, mid="m2"),
        row("Publication", None, mid="m2"),
        row("Reception", None, mid="m3"),
        row("Publication", 40, mid="m3"),
        row("Serializing", None, mid="m4", topic=None),
        row("Publication", 50, mid="m4", topic=None),
    ]
    got = {
        (r["message_id"], r["event_type"]): r["serialized_size"]
        for r in fill_sizes(spark.createDataFrame(rows, SCHEMA)).collect()
    }
    assert got == {
        ("m1", "Serializing"): 10,
        ("m1", "Publication"): 10,
        ("m1", "Reception"): 20,
        ("m1", "Deserialized"): 20,
        ("m2", "Serializing"): None,
        ("m2", "Publication"): 30,
        ("m2", "Deserialized"): 30,
        ("m3", "Reception"): None,
        ("m3", "Publication"): 40,
        ("m4", "Serializing"): None,
        ("m4", "Publication"): 50,
    }


def test_windows_equal_the_built_in_sliding_window(spark):
    rnd = random.Random(5)
    rows = [
        row(
            rnd.choice(["Publication", "Reception"]),
            rnd.choice([None, rnd.randrange(1, 10**7)]),
            rnd.random() * 30,
            mid=f"m{i}",
            run=rnd.choice(["r0", "r1"]),
        )
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {
        (r["run"], r["event_type"], r["time_s"]): round(r["throughput_mb_s"], 9)
        for r in throughput(df, 4).collect()
    }
    start = df.groupBy(*RUN).agg(F.unix_millis(F.min("timestamp")).alias("start"))
    plain = (
        df.filter("serialized_size is not null")
        .groupBy(*RUN, "event_type", F.window("timestamp", "4 seconds", "1 second").alias("w"))
        .agg(F.sum("serialized_size").alias("b"))
        .join(start, RUN)
        .withColumn("time_s", F.floor((F.unix_millis("w.start") - F.col("start")) / 1000))
        .filter("time_s >= 0")
    )
    want = {
        (r["run"], r["event_type"], r["time_s"]): round(r["b"] / 4 / 1e6, 9) for r in plain.collect()
    }
    assert got == want


def test_time_origin_is_the_first_event_of_any_stage(spark):
    rows = [row("Serializing", None, 0), row("Publication", 2_000_000, 2.0)]
    got = [(r["time_s"], r["throughput_mb_s"]) for r in throughput(
        spark.createDataFrame(rows, SCHEMA), 1, ["Publication"]
    ).collect()]
    # Run starts at .400; the window starting at second 2 begins 1.6 s later.
    assert got == [(1, 2.0)]


def curve(spark, points):
    return spark.createDataFrame(
        [("s", "t", r, "Publication", t, float(v)) for r, t, v in points],
        "scenario string, tech string, run string, event_type string, time_s bigint, throughput_mb_s double",
    )


def test_trim_drops_at_least_one_window(spark):
    df = curve(spark, [("r0", t, 1) for t in range(21)])
    times = sorted(r["time_s"] for r in trim_throughput(df, window_s=10, start_s=5, end_s=5).collect())
    assert times == [5, 6, 7, 8, 9, 10]
    assert trim_throughput(df, window_s=10, start_s=15, end_s=5).collect() == []


def test_average_uses_the_runs_that_have_the_time(spark):
    df = curve(spark, [("r0", 0, 1), ("r0", 1, 3), ("r1", 1, 5)])
    got = average_curve(df, ["tech"], ["throughput_mb_s"]).orderBy("time_s").collect()
    assert [(r["time_s"], r["throughput_mb_s"]) for r in got] == [(0, 1.0), (1, 4.0)]
    table = mean_throughput_table(df).collect()
    assert [r["mean_throughput_mb_s"] for r in table] == [3.5 - 0.0]
    shown = {(r["series"], r["time_s"]) for r in throughput_display(df).collect()}
    assert ("t (avg)", 1) in shown and ("t (r1)", 1) in shown
    assert {r["run"] for r in throughput_display(df, False).collect()} == {"avg"}


def test_curve_quality(spark):
    df = curve(spark, [("ok", 0, 1), ("ok", 1, 1), ("twice", 2, 1), ("twice", 2, 1), ("early", -1, 1)])
    got = {r["run"]: r["valid"] for r in curve_quality(df, RUN).collect()}
    assert got == {"ok": True, "twice": False, "early": False}

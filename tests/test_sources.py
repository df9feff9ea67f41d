"""Readers over real folder trees, parsing and catalogue rules."""

from __future__ import annotations

import json
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidewire.functions.labels import file_stem, source_label
from tidewire.functions.lenient import parse_timestamp, size_field
from tidewire.plans.resources import resource_usage
from tidewire.sources.catalog import (
    list_run_files,
    log_roots,
    nominal_duration,
    run_catalog,
    run_specs,
    selected_runs,
)
from tidewire.sources.event_log import (
    normalise_events,
    read_event_log,
    read_run_directories,
    write_event_log,
)
from tidewire.sources.logs import (
    level_counts,
    parse_study_lines,
    read_container_logs,
    read_run_logs,
    runtime_config,
)
from tidewire.functions.ranges import double_text
from tidewire.sources.resources import read_resource_files, unread_resource_files
from tidewire.sources.scenarios import read_batches, read_scenarios
from tidewire.sources.stats import cpu_percent, flatten_stats


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())


def put_events(path, **columns):
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table(columns), path)


def test_run_directories_with_old_and_all_null_columns(spark, tmp_path):
    put_events(
        tmp_path / "logs" / "s" / "alpha" / "001" / "a_events.parquet",
        timestamp=["2025-01-01 10:00:00.123456", "2025-01-01 10:00:01.5", "bad"],
        event_type=["Serializing", "DeliveryError", "Reception"],
        message_id=["P0-1", "P0-1", "P0-1"],
        topic=["0", "0", "0"],
    )
    put_events(
        tmp_path / "logs_v2" / "s" / "beta" / "r1" / "b_events.parquet",
        container_name=["beta-P0", "beta-P0"],
        timestamp=["2025-01-01 10:00:00", "2025-01-01 10:00:00"],
        event_type=["Publication", "Publication"],
        message_id=["P0-1", None],
        logical_size=pa.array([-1, 4]),
        topic=["0", "0"],
        serialized_size=pa.array([7, 8]),
    )
    got = {
        (r["logs_root"], r["tech"], r["run"], r["event_type"]): (
            r["timestamp"],
            r["container_name"],
            r["serialized_size"],
        )
        for r in read_run_directories(spark, str(tmp_path)).collect()
    }
    assert got == {
        ("logs", "alpha", "001", "Serializing"): (datetime(2025, 1, 1, 10, 0, 0, 123456), None, None),
        ("logs", "alpha", "001", "Reception"): (None, None, None),
        ("logs_v2", "beta", "r1", "Publication"): (datetime(2025, 1, 1, 10), "beta-P0", 7),
    }
    only = read_run_directories(spark, str(tmp_path), techs=["beta"], runs=["r1"])
    assert {r["tech"] for r in only.select("tech").collect()} == {"beta"}
    assert only.inputFiles() and all("/beta/" in f for f in only.inputFiles())


def test_null_typed_columns(spark, tmp_path):
    put_events(
        tmp_path / "logs" / "s" / "t" / "r" / "e.parquet",
        container_name=["c"],
        timestamp=["2025-01-01 10:00:00"],
        event_type=["Serializing"],
        message_id=["m"],
        logical_size=pa.nulls(1),
        topic=["0"],
        serialized_size=pa.nulls(1),
    )
    put_events(
        tmp_path / "logs" / "s" / "t" / "r2" / "e.parquet",
        container_name=["c"],
        timestamp=["2025-01-01 10:00:00"],
        event_type=["Publication"],
        message_id=["m"],
        logical_size=pa.array([5]),
        topic=["0"],
        serialized_size=pa.array([6]),
    )
    rows = read_run_directories(spark, str(tmp_path)).collect()
    assert sorted((r["run"], r["logical_size"], r["serialized_size"]) for r in rows) == [
        ("r", None, None),
        ("r2", 5, 6),
    ]


def test_filters_reach_the_parquet_reader(spark, tmp_path):
    df = spark.createDataFrame(
        [("s", "t", "01", "c", datetime(2025, 1, 1), "Publication", "m", 1, "0", 2)],
        "scenario string, tech string, run string, container_name string, timestamp timestamp, "
        "event_type string, message_id string, logical_size bigint, topic string, serialized_size bigint",
    )
    path = str(tmp_path / "log")
    write_event_log(df, path)
    write_event_log(df.withColumn("run", F.lit("02")), path)
    back = read_event_log(spark, path)
    assert sorted(r["run"] for r in back.collect()) == ["01", "02"]
    plan = back.filter("run = '02'").select("timestamp")._jdf.queryExecution().toString()
    assert "In(event_type" in plan and "IsNotNull(message_id)" in plan
    assert "PartitionFilters: [isnotnull(run" in plan


def test_log_parsing_rules(spark, tmp_path):
    text = "\n".join(
        [
            "[STUDY] 2025-01-01 10:00:00.123456,Serializing,P0-17,0",
            "[STUDY] 2025-01-01 10:00:00.124001,Publication,P0-17,0,10485760,10485776",
            "[INFO] 2025-01-01 10:00:00.124050,[App] Published,P0-17,10485776,0",
            "[STUDY] 2025-01-01 10:00:00.1,Reception,P0-17",
            "[STUDY] ,Reception,P0-17,0",
            "[STUDY] 2025-01-01 10:00:00.1,Reception,P0-17,0,12.0,x",
            "[STUDY] 2025-01-01 10:00:00.1,Reception,P0-17,0,12.9,",
            "[STUDY] 2025-01-01 10:00:00.1,Reception,P0-17,0,1,2,3",
            "",
        ]
    )
    put(tmp_path / "alpha-P0.log", text.replace("\n", "\r\n").encode() + b"[DEBUG] \xff\xfe\n")
    lines = read_container_logs(spark, str(tmp_path / "*.log"))
    got = parse_study_lines(lines).collect()
    assert [(r["event_type"], r["logical_size"], r["serialized_size"]) for r in got] == [
        ("Serializing", None, None),
        ("Publication", 10485760, 10485776),
        ("Reception", 12, None),
    ]
    assert {r["container_name"] for r in got} == {"alpha-P0"}
    typed = normalise_events(
        parse_study_lines(lines).select("*", *[F.lit("x").alias(k) for k in ("scenario", "tech", "run")])
    )
    assert typed.filter("timestamp is not null").count() == 3
    levels = {r["level"]: r["n_lines"] for r in level_counts(lines).collect()}
    assert levels == {"STUDY": 7, "INFO": 1, "DEBUG": 1}


def test_size_field(spark):
    cases = {
        "12": 12, "+7": 7, "-1": -1, "1_000": 1000, "12.9": 12, "-12.9": -12, "1.5e3": 1500,
        "": None, "x": None, "1e3": None, "nan": None, "1.5f": None, "99999999999999999999": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["n"] for r in df.select("t", size_field(F.col("t")).alias("n")).collect()} == cases


def test_timestamps(spark):
    cases = {
        "2025-01-01 10:00:00.123456": True,
        "2025-01-01T10:00:00.5": True,
        "2025-01-01 10:00:00": True,
        "10:00:00": False,
        "2025-13-01 10:00:00": False,
        "": False,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = df.select("t", parse_timestamp(F.col("t")).isNotNull().alias("ok")).collect()
    assert {r["t"]: r["ok"] for r in got} == cases


def test_runtime_config_from_files(spark, tmp_path):
    head = "[CONFIG] 2025-01-01 10:00:00.000001,"
    put(
        tmp_path / "c1.log",
        f"{head}[CONFIG] EARLY=1\n{head}[Client] [CONFIG_BEGIN]\n{head}[CONFIG] URL=a=b,c\n"
        f"{head}[CONFIG] N = 1 \n{head}[CONFIG] N=2\n{head}[Client] [CONFIG_END]\n{head}[CONFIG] LATE=1\n",
    )
    put(tmp_path / "c2.log", f"{head}[Client] [CONFIG_END]\n{head}[CONFIG_BEGIN]\n{head}[CONFIG] A=1\n")
    put(tmp_path / "c3.log", f"{head}KEY: value\n{head}[CONFIG_END]\n")
    got = runtime_config(read_container_logs(spark, str(tmp_path / "*.log"))).collect()
    assert {(r["container_name"], r["key"], r["value"]) for r in got} == {
        ("c1", "URL", "a=b,c"),
        ("c1", "N", "2"),
    }


def test_resource_files_of_two_ages(spark, tmp_path):
    run = tmp_path / "logs" / "s" / "t" / "r"
    put(
        run / "s_t-P0.csv",
        "timestamp,cpu_usage_ns,cpu_usage_perc,memory_usage,page_cache,network_rx,network_tx,disk_read,disk_write\n"
        "2025-01-01T10:00:00.000000,1,5.5,1048576,2097152,0,0,0,0\n"
        "2025-01-01T10:00:02.000000,2,6.5,1048576,2097152,4000000,1,1000000,1000000\n"
        "2025-01-01T10:00:04.000000,2,6.5,1,1,1,1,,1\n",
    )
    put(
        run / "benchmark_t_broker.csv",
        "timestamp,cpu_usage_perc,network_rx,memory_usage\n"
        "2025-01-01T10:00:01,1.5,7,bad\n2025-01-01T10:00:03,1.5,5,1048576\n",
    )
    put(run / "s_t-C0.csv", "timestamp,cpu_usage_perc\n2025-01-01T10:00:01,50\n")
    samples = read_resource_files(spark, str(tmp_path))
    assert {r["source"] for r in samples.select("source").distinct().collect()} == {"P0", "Broker", "C0"}
    broker = samples.filter("source = 'Broker'").orderBy("timestamp").first()
    assert (broker["memory_usage"], broker["network_rx"], broker["disk_read"]) == (0.0, 7.0, 0.0)
    got = [
        (r["time_s"], r["cpu_usage_perc"], r["memory_mb"], r["disk_throughput_mb_s"], r["network_rx_mb_s"])
        for r in resource_usage(samples.drop("logs_root")).orderBy("time_s").collect()
    ]
    # Ordinals line up across sources; the third sample only exists in P0.
    assert got[0] == (0, 7.0, 1.0, 0.0, 0.0)
    assert got[1] == (2, 8.0, 2.0, 1.0, 2.0)
    assert len(got) == 3 and got[2][3:] == (0.0, 0.0)


def test_resource_headers_in_any_order_and_quoting(spark, tmp_path):
    for name, text in {
        "s_t-P0.csv": "timestamp,network_rx\n2025-01-01T10:00:01,1\n",
        "s_t-P1.csv": "network_rx,timestamp\n2,2025-01-01T10:00:01\nnetwork_rx,timestamp\n\n3,2025-01-01T10:00:02\n",
        "s_t-P2.csv": '\ufeff"network_rx","note, ""x""","timestamp"\r\n"4","a, ""b""",2025-01-01T10:00:01\r\n',
        "s_t-P3.csv": "network_rx,time\n5,2025-01-01T10:00:01\n",
        "s_t-P4.csv": "",
    }.items():
        put(tmp_path / "logs" / "s" / "t" / "r" / name, text)
    got = read_resource_files(spark, str(tmp_path)).collect()
    assert all(r["timestamp"] is not None for r in got)
    assert sorted((r["source"], r["network_rx"]) for r in got) == [("P0", 1), ("P1", 2), ("P1", 3), ("P2", 4)]
    lost = {r["file"][-10:]: r["reason"] for r in unread_resource_files(spark, str(tmp_path)).collect()}
    assert lost == {"s_t-P3.csv": "no timestamp column"} or lost == {
        "s_t-P3.csv": "no timestamp column",
        "s_t-P4.csv": "no header",
    }
    assert unread_resource_files(spark, str(tmp_path / "none")).count() == 0


def test_a_large_resource_file_is_read_in_splits(spark, tmp_path):
    run, n = tmp_path / "logs" / "s" / "t" / "r", 2000
    times = [f"2025-01-01T10:{i // 60 % 60:02}:{i % 60:02}" for i in range(n)]
    head = "network_rx,timestamp\r\n"
    lines = [f"{i},{t}\r\n" for i, t in enumerate(times)]
    put(run / "s_t-P0.csv", "\ufeff" + head + "".join(lines[:1500]) + head + "".join(lines[1500:]))
    put(run / "s_t-P1.csv", "timestamp,network_rx\n2025-01-01T10:00:01,7\n")
    put(run / "s_t-P2.csv", "\ufeff")
    put(run / "s_t-P3.csv", "\n")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in kept:
            spark.conf.set(k, "4096")
        samples = read_resource_files(spark, str(tmp_path))
        got = samples.select("source", "timestamp", "network_rx", F.spark_partition_id().alias("task")).collect()
        lost = {r["file"][-10:]: r["reason"] for r in unread_resource_files(spark, str(tmp_path)).collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len({r["task"] for r in got if r["source"] == "P0"}) > 5
    assert sorted(r["network_rx"] for r in got if r["source"] == "P0") == list(range(n))
    assert all(r["timestamp"].second == r["network_rx"] % 60 for r in got if r["source"] == "P0")
    assert [r["network_rx"] for r in got if r["source"] == "P1"] == [7]
    assert lost == {"s_t-P2.csv": "no header", "s_t-P3.csv": "no header"}


def test_equal_containers_of_two_runs_keep_their_settings(spark, tmp_path):
    head = "[CONFIG] 2025-01-01 10:00:00.000001,"
    for run, value in (("r1", "one"), ("r2", "two")):
        put(
            tmp_path / "logs" / "s" / "t" / run / "c.log",
            f"{head}[Client] [CONFIG_BEGIN]\n{head}[CONFIG] URL={value}\n{head}[CONFIG_END]\n",
        )
    got = runtime_config(read_run_logs(spark, str(tmp_path))).collect()
    assert {(r["run"], r["container_name"], r["value"]) for r in got} == {("r1", "c", "one"), ("r2", "c", "two")}
    assert runtime_config(read_run_logs(spark, str(tmp_path / "none"))).count() == 0


def test_parts_with_other_fields_count(spark):
    rows = [
        ('{"cpu_stats": {"online_cpus": 4}, "memory_stats": {"limit": 1}}', 1),
        ('{"cpu_stats": {}, "memory_stats": {"usage": 1}}', 2),
        ('{"cpu_stats": {"system_cpu_usage": 5}, "memory_stats": { }}', 3),
    ]
    df = spark.createDataFrame(rows, "stats string, k int")
    assert [(r["k"], r["memory_usage"]) for r in flatten_stats(df, ["k"]).collect()] == [(1, 0)]
    two = spark.createDataFrame(
        [("a", 0, 0, 0, 2), ("a", 1, 10, 40, 2), ("b", 0, 0, 0, 4), ("b", 1, 10, 40, 4)],
        "k string, us bigint, cpu_usage_ns bigint, system_cpu_ns bigint, n int",
    )
    got = cpu_percent(two, ["k"], "us", [], F.col("n")).filter("us = 1").collect()
    assert {r["k"]: r["cpu_usage_perc"] for r in got} == {"a": 50.0, "b": 100.0}


def test_number_texts(spark):
    values = [1e7, 1e-4, 0.1, 12345678.5, 1.5e-5, 1e16, 2.5e20, 1e-10, 123456789012345.6, -1e7, 0.00123, 3.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r["t"] for r in df.select(double_text(F.col("v")).alias("t")).collect()] == [str(v) for v in values]


def test_run_without_producer_has_no_curve(spark):
    df = spark.createDataFrame(
        [("s", "t", "r", "Broker", datetime(2025, 1, 1))],
        "scenario string, tech string, run string, source string, timestamp timestamp",
    )
    for c in ("cpu_usage_ns", "cpu_usage_perc", "memory_usage", "page_cache", "network_rx",
              "network_tx", "disk_read", "disk_write"):
        df = df.withColumn(c, F.lit(1.0))
    assert resource_usage(df).collect() == []


def test_labels(spark):
    names = {"/x/s_t-P0.csv": "P0", "/x/benchmark_t_broker.csv": "Broker", "/x/plain.csv": "plain"}
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = df.select("p", source_label(file_stem(F.col("p"))).alias("s")).collect()
    assert {r["p"]: r["s"] for r in got} == names


def test_catalogue_from_folders(spark, tmp_path):
    for path in (
        "logs/s1/alpha/r1/1p1c1t10b-30s_events.parquet",
        "logs/s1/alpha/r2/x.csv",
        "logs/s1/.cache/r1/9s.csv",
        "logs_v2/s1/beta/r1/10s.csv",
        "other/s1/alpha/r1/5s.csv",
    ):
        put(tmp_path / path, "x")
    files = list_run_files(spark, str(tmp_path))
    catalog = run_catalog(files)
    assert {tuple(r) for r in catalog.collect()} == {
        ("logs", "s1", "alpha", "r1"),
        ("logs", "s1", "alpha", "r2"),
        ("logs_v2", "s1", "beta", "r1"),
    }
    assert {r["logs_root"]: r["is_default"] for r in log_roots(catalog).collect()} == {
        "logs": True,
        "logs_v2": False,
    }
    specs = run_specs(catalog, ["beta", "alpha"])
    assert {(r["tech"], r["tech_position"]) for r in specs.collect()} == {("beta", 1), ("alpha", 2)}
    assert [r["run"] for r in selected_runs(specs).collect()] == ["r1", "r2"]
    assert {(r["logs_root"], r["duration_s"]) for r in nominal_duration(files).collect()} == {
        ("logs", 30),
        ("logs_v2", 10),
    }


def test_statistics_without_figures_are_dropped(spark):
    full = {
        "cpu_stats": {"cpu_usage": {"total_usage": 10}, "system_cpu_usage": 100},
        "memory_stats": {"usage": 5, "stats": {"active_file": 3, "inactive_file": 4}},
        "networks": None,
        "blkio_stats": {"io_service_bytes_recursive": None},
    }
    later = dict(full, cpu_stats={"cpu_usage": {"total_usage": 20}, "system_cpu_usage": 140})
    rows = [
        (1, json.dumps(full)),
        (2, json.dumps(later)),
        (3, json.dumps(dict(full, memory_stats={}))),
        (4, json.dumps(dict(full, cpu_stats=None))),
    ]
    flat = flatten_stats(spark.createDataFrame(rows, "us bigint, stats string"), ["us"])
    got = flat.orderBy("us").collect()
    assert [(r["us"], r["memory_usage"], r["page_cache"], r["network_rx"], r["disk_read"]) for r in got] == [
        (1, 0, 7, 0, 0),
        (2, 0, 7, 0, 0),
    ]
    cpu = cpu_percent(flat.withColumn("k", F.lit("c")), ["k"], "us", [], num_cpus=2)
    assert [r["cpu_usage_perc"] for r in cpu.orderBy("us").collect()] == [0.0, 50.0]


def test_scenario_files(spark, tmp_path):
    one = {"lower": 1, "upper": 1, "step": 1, "step_operator": "+"}
    put(
        tmp_path / "demo.json",
        json.dumps({"consumerAssignmentStrategy": ["shared"], "common": {"numTopics": one}}, indent=4),
    )
    row = read_scenarios(spark, str(tmp_path / "demo.json")).first()
    assert row["config"] == "demo" and row["common"]["numTopics"]["upper"] == 1.0
    put(tmp_path / "batch.json", json.dumps({"scenario_batch": ["demo.json"], "technologies": ["a"]}))
    assert read_batches(spark, str(tmp_path / "batch.json")).first()["technologies"] == ["a"]

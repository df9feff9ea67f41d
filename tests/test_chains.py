"""Growing logs, statistics to samples, documents as files, and large grids."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from tidewire.plans import scenarios as sc
from tidewire.schemas import RUN, SCENARIO_SCHEMA
from tidewire.sources.documents import client_files, read_client_documents, write_documents
from tidewire.sources.event_log import normalise_events, read_event_log
from tidewire.sources.logs import parse_study_lines, read_run_logs
from tidewire.sources.stats import read_stats_files, stats_samples
from tidewire.streaming.ingest import LOG, ingest_new_logs, replace_logs


def _put(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write("".join(f"{x}\n" for x in lines))


def _line(second, message):
    return f"[STUDY] 2025-01-01 10:00:{second:02d}.000000,Publication,{message},t,1,2"


def test_logs_are_ingested_once_whatever_is_replayed(spark, tmp_path):
    run, out = f"{tmp_path}/logs/s/t/01", f"{tmp_path}/out"
    _put(run, "P0.log", [_line(1, "a"), "[INFO] x", "[STUDY] broken"])
    ingest_new_logs(spark, str(tmp_path), out, f"{tmp_path}/c1")
    _put(run, "C0.log", [_line(2, "b"), _line(2, "b")])
    ingest_new_logs(spark, str(tmp_path), out, f"{tmp_path}/c1")
    # Nothing new, then every file once more under a checkpoint that knows none.
    ingest_new_logs(spark, str(tmp_path), out, f"{tmp_path}/c1")
    ingest_new_logs(spark, str(tmp_path), out, f"{tmp_path}/c2")
    rows = read_event_log(spark, out).select("run", "container_name", "message_id").collect()
    assert sorted(map(tuple, rows)) == [("01", "C0", "b"), ("01", "C0", "b"), ("01", "P0", "a")]


def test_logs_are_written_by_the_tasks_that_parsed_them(spark, tmp_path):
    lines = [f"[STUDY] 2025-01-01 10:00:00.{i:06d},Reception,P0-{i},t" for i in range(20_000)]
    logs = spark.createDataFrame([(x,) for x in lines], "line string").repartition(1)
    logs.write.text(f"{tmp_path}/logs/demo/alpha/r0")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300000")
    group = "ingest"
    spark.sparkContext.setJobGroup(group, group)
    try:
        read = read_run_logs(spark, str(tmp_path), "txt").withColumn(LOG, F.lit("a"))
        parsed = parse_study_lines(read, [*RUN, LOG, "container_name"])
        replace_logs(normalise_events(parsed, [*RUN, LOG]), f"{tmp_path}/out")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    status = spark.sparkContext.statusTracker()
    stages = [status.getJobInfo(j).stageIds for j in status.getJobIdsForGroup(group)]
    assert sum(map(len, stages)) == 1
    assert len(list((tmp_path / "out").rglob("*.parquet"))) > 1
    assert read_event_log(spark, f"{tmp_path}/out").select("message_id").distinct().count() == 20_000


def test_documents_are_files_of_their_rows(spark, tmp_path):
    rows = [("s", "t", "r", "1p-3s", "P0", '{"pub_id":"P0"}'), ("s", "t", "r", "1p-3s", "C0", None)]
    docs = spark.createDataFrame(
        rows, "scenario string, tech string, run string, name string, client_id string, document string"
    )
    write_documents(client_files(docs), f"{tmp_path}/logs")
    assert sorted(os.listdir(tmp_path / "logs")) == ["s"]
    with open(tmp_path / "logs/s/t/r/1p-3s_t-P0_scenarioconfig.json") as f:
        assert json.load(f) == {"pub_id": "P0"}
    back = read_client_documents(spark, f"{tmp_path}/logs").select("scenario", "tech", "run", "file")
    assert {tuple(r) for r in back.collect()} >= {("s", "t", "r", "1p-3s_t-P0")}
    assert read_client_documents(spark, f"{tmp_path}/none").count() == 0


def test_reading_documents_takes_no_task_per_folder(spark, tmp_path):
    wanted = set()
    for i in range(300):
        name = (f"s {i}", "t", f"r{i % 2}", f"1p_t-P{i}")
        _put(f"{tmp_path}/logs/{'/'.join(name[:3])}", f"{name[3]}_scenarioconfig.json", ["{}"])
        wanted.add((*name, "{}\n"))
    _put(f"{tmp_path}/logs/s 1/t/r1", "other.json", ["{}"])
    sc = spark.sparkContext
    sc.setJobGroup("documents", "documents")
    back = read_client_documents(spark, f"{tmp_path}/logs").collect()
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("documents") for s in tracker.getJobInfo(j).stageIds}
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert {tuple(r) for r in back} == wanted and len(back) == 300
    assert sum(i.numTasks for i in map(tracker.getStageInfo, stages) if i) < 100


def test_a_failed_job_publishes_no_document(spark, tmp_path):
    fails = F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.lit("{}")).cast("string")
    docs = spark.range(0, 8, 1, 4).select(F.concat("id", F.lit(".json")).alias("file"), fails.alias("document"))
    with pytest.raises(Exception, match="lost"):
        write_documents(docs, f"{tmp_path}/d")
    assert [n for n in os.listdir(tmp_path / "d") if not n.startswith("_")] == []
    twice = spark.createDataFrame([("a", "1"), ("a", "2"), (None, "3")], "file string, document string")
    with pytest.raises(ValueError, match="named a"):
        write_documents(twice, f"{tmp_path}/e")
    assert os.listdir(tmp_path / "e") == []


def test_stats_samples_skip_what_has_no_figures(spark, tmp_path):
    def doc(second, used, total, cpus=2, **parts):
        full = {"cpu_stats": {"cpu_usage": {"total_usage": used}, "system_cpu_usage": total}}
        full["memory_stats"] = {"usage": 10, "stats": {"file": 4}}
        time = None if second is None else f"2025-01-01T10:00:{second:02d}.000000"
        return json.dumps({"container": "t-P0", "timestamp": time, "num_cpus": cpus, "stats": full | parts})

    lines = [doc(1, 10, 100), doc(2, 99, 200, memory_stats={}), doc(None, 1, 1), doc(3, 60, 300), "broken"]
    _put(f"{tmp_path}/logs/s/t/r", "P0.jsonl", lines)
    rows = stats_samples(read_stats_files(spark, str(tmp_path))).orderBy("timestamp").collect()
    # The skipped sample is no predecessor: 50 of 200 on two processors.
    assert [(r["source"], r["cpu_usage_perc"], r["memory_usage"]) for r in rows] == [("P0", 0.0, 6.0), ("P0", 50.0, 6.0)]
    assert stats_samples(read_stats_files(spark, str(tmp_path), "none")).count() == 0


def _config(spark, strategies, **uppers):
    def span(upper):
        return {"lower": 1.0, "upper": float(upper), "step": 1.0, "step_operator": "+"}

    document = {"producerAssignmentStrategy": ["round-robin"], "consumerAssignmentStrategy": strategies}
    for group in ("common", "network", "exclusive"):
        names = SCENARIO_SCHEMA[group].dataType.names
        document[group] = {n: span(uppers.get(n, 1)) for n in names}
    rows = spark.createDataFrame([("c", json.dumps(document))], "config string, d string")
    return rows.select("config", F.from_json("d", SCENARIO_SCHEMA).alias("s")).select("config", "s.*")


def test_a_grid_of_many_combinations_is_the_work_of_many_tasks(spark):
    wide = _config(spark, ["shared", "random"], numTopics=100, latencyMs=50, messageSizeBytes=20)
    grid = sc.scenario_grid(wide, "testDurationS")
    places = ("numTopics", "latencyMs", "messageSizeBytes", "consumerAssignmentStrategy")
    counted = grid.select(F.count("*"), F.count_distinct(*places)).first()
    assert tuple(counted) == (200_000, 200_000)
    busy = grid.groupBy(F.spark_partition_id().alias("task")).count()
    assert busy.count() > 1 and busy.agg(F.max("count")).first()[0] < 200_000


def test_a_dimension_without_values_leaves_no_combination(spark):
    assert sc.scenario_grid(_config(spark, ["shared"], numTopics=0), "testDurationS").count() == 0
    assert sc.scenario_grid(_config(spark, []), "testDurationS").count() == 0
    assert sc.scenario_grid(_config(spark, ["shared", None]), "testDurationS").count() == 1

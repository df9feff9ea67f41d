"""The whole page from run folders, through the command line."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidewire.__main__ import main
from tidewire.plans.report import Selection, report
from tidewire.sources.event_log import read_event_log


def write_run(folder, tech, shift):
    folder.mkdir(parents=True)
    rows = []
    for i in range(300):
        at = i * 100 + shift
        for kind, container, lag, size in (
            ("Serializing", "P0", 0, None),
            ("Publication", "P0", 3, 1000),
            ("Reception", "C0", 9, None),
            ("Deserialized", "C0", 11, 1000),
        ):
            ms = at + lag
            rows.append(
                {
                    "container_name": f"{tech}-{container}",
                    "timestamp": f"2025-01-01 10:00:{ms // 1000:02d}.{ms % 1000:03d}000",
                    "event_type": kind,
                    "message_id": f"P0-{i}",
                    "logical_size": size,
                    "topic": "0",
                    "serialized_size": size,
                }
            )
    pq.write_table(pa.Table.from_pylist(rows), folder / "x_events.parquet")
    lines = ["timestamp,cpu_usage_perc,memory_usage"]
    lines += [f"2025-01-01T10:00:{2 * i:02d},{shift}.0,1048576" for i in range(10)]
    (folder / f"x_{tech}-P0.csv").write_text("\n".join(lines) + "\n")


def test_report(spark, tmp_path):
    write_run(tmp_path / "logs" / "demo" / "alpha" / "r0", "alpha", 0)
    write_run(tmp_path / "logs" / "demo" / "alpha" / "r1", "alpha", 2)
    write_run(tmp_path / "logs" / "demo" / "beta" / "r0", "beta", 0)
    write_run(tmp_path / "logs" / "other" / "alpha" / "r0", "alpha", 0)
    out = tmp_path / "out"
    main(["report", str(tmp_path), "demo", str(out), "--techs", "alpha", "--window", "2", "--individual"])
    table = {n: spark.read.parquet(str(out / n)).collect() for n in
             ("throughput", "mean_throughput", "latency", "resources")}
    assert {(r["scenario"], r["tech"]) for r in table["throughput"]} == {("demo", "alpha")}
    assert {r["run"] for r in table["throughput"]} == {"avg", "r0", "r1"}
    assert {r["event_type"] for r in table["mean_throughput"]} == {
        "Publication", "Reception", "Deserialized",
    }
    # Ten messages of 1000 bytes a second.
    assert {r["mean_throughput_mb_s"] for r in table["mean_throughput"]} == {0.01}
    got = {r["segment"]: (r["P50"], r["Max"]) for r in table["latency"]}
    assert got == {
        "serializing_to_publication": (3.0, 3.0),
        "publication_to_reception": (6.0, 6.0),
        "reception_to_deserialized": (2.0, 2.0),
        "end_to_end": (11.0, 11.0),
    }
    cpu = {(r["run"], r["value"]) for r in table["resources"] if r["metric"] == "cpu_usage_perc"}
    assert cpu == {("avg", 1.0), ("r0", 0.0), ("r1", 2.0)}


def frames_of(frames):
    return {n: sorted(tuple(r) for r in f.collect()) for n, f in frames.items()}


def test_report_through_the_store(spark, tmp_path, monkeypatch):
    from tidewire.plans import report as module

    for tech, run, shift in (("alpha", "r0", 0), ("alpha", "r1", 2), ("beta", "r0", 0)):
        write_run(tmp_path / "logs" / "demo" / tech / run, tech, shift)
    opened = []
    read = module.read_run_folders

    def noted(spark, folders):
        opened.append(sorted("/".join(f.split("/")[-2:]) for f in folders))
        return read(spark, folders)

    monkeypatch.setattr(module, "read_run_folders", noted)
    base, root = str(tmp_path), str(tmp_path / "store")
    for offsets in ((5, 5), (0, 0)):
        wanted = Selection("demo", start_offset_s=offsets[0], end_offset_s=offsets[1], show_individual=True)
        assert frames_of(report(spark, base, wanted, root)) == frames_of(report(spark, base, wanted))
    assert opened == [["alpha/r0", "alpha/r1", "beta/r0"]] * 2
    # One run loses a stage, another all its rows that have a size.
    del opened[:]
    for run, stages in (("r0", ("Serializing", "Publication")), ("r1", ("Serializing",))):
        file = tmp_path / "logs" / "demo" / "alpha" / run / "x_events.parquet"
        rows = pq.read_table(file).to_pylist()
        pq.write_table(pa.Table.from_pylist([r for r in rows if r["event_type"] in stages]), file)
    got = frames_of(report(spark, base, wanted, root))
    assert got == frames_of(report(spark, base, wanted))
    assert opened == [["alpha/r0", "alpha/r1"]] * 2
    shown = {(r[1], r[2], r[3]) for r in got["throughput"]}
    assert ("alpha", "r0", "Publication") in shown
    assert not [r for r in shown if r[:2] == ("alpha", "r1") or r[:2] == ("alpha", "r0") and r[2] != "Publication"]


def test_report_of_nothing_is_empty(spark, tmp_path):
    frames = report(spark, str(tmp_path), Selection("demo"))
    assert all(f.collect() == [] for f in frames.values())


def test_ingest(spark, tmp_path):
    (tmp_path / "kafka-P0.log").write_text(
        "[STUDY] 2025-01-01 10:00:00.1,Serializing,P0-1,0\n[INFO] x\n"
        "[STUDY] 2025-01-01 10:00:00.2,Publication,P0-1,0,5,21\n"
    )
    main(["ingest", str(tmp_path / "*.log"), str(tmp_path / "log"), "demo", "kafka", "007"])
    rows = read_event_log(spark, str(tmp_path / "log")).orderBy("timestamp").collect()
    assert [(r["run"], r["container_name"], r["event_type"], r["serialized_size"]) for r in rows] == [
        ("007", "kafka-P0", "Serializing", None),
        ("007", "kafka-P0", "Publication", 21),
    ]


def test_selection_limits():
    with pytest.raises(ValueError):
        Selection("s", window_s=0)
    with pytest.raises(ValueError):
        Selection("s", end_offset_s=-1)

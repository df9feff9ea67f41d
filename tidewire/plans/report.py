"""The analysis page of a scenario: all frames for a selection of runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.plans import latency as lat
from tidewire.plans import resources as res
from tidewire.plans import throughput as thr
from tidewire.schemas import RESOURCE_METRICS, RUN
from tidewire.session import materialise
from tidewire.plans.curves import curve_quality, missing_segments
from tidewire.plans.store import load_or_compute, metric_path, with_event_label, with_event_type
from tidewire.sources.catalog import run_inputs
from tidewire.sources.event_log import (
    any_file,
    read_run_directories,
    read_run_folders,
    run_file_glob,
)
from tidewire.sources.resources import read_resource_files


@dataclass(frozen=True)
class Selection:
    """What to analyse; empty technologies or runs mean all of them."""

    scenario: str
    logs_root: str = "logs"
    techs: Sequence[str] = ()
    runs: Sequence[str] = ()
    window_s: int = thr.DEFAULT_WINDOW_S
    start_offset_s: int = thr.DEFAULT_TRIM_S
    end_offset_s: int = thr.DEFAULT_TRIM_S
    show_individual: bool = False

    def __post_init__(self) -> None:
        if self.window_s < 1:
            raise ValueError("window_s must be at least 1")
        if min(self.start_offset_s, self.end_offset_s) < 0:
            raise ValueError("offsets must not be negative")

    def paths(self) -> dict[str, Sequence[str]]:
        return {
            "roots": [self.logs_root],
            "scenarios": [self.scenario],
            "techs": self.techs,
            "runs": self.runs,
        }


def event_frames(events: DataFrame, s: Selection) -> dict[str, DataFrame]:
    """Throughput curves and means, and the latency table."""
    stats = lat.latency_trimmed(events, s.start_offset_s, s.end_offset_s)
    return _event_frames(thr.throughput(events, s.window_s), stats, s)


def _event_frames(curve: DataFrame, stats: DataFrame, s: Selection) -> dict[str, DataFrame]:
    trimmed = materialise(
        thr.trim_throughput(curve, s.window_s, s.start_offset_s, s.end_offset_s), "trimmed-curves"
    )
    return {
        "throughput": thr.throughput_display(trimmed, s.show_individual),
        "mean_throughput": thr.mean_throughput_table(trimmed),
        "latency": lat.latency_table(lat.average_latency(stats)),
    }


def resource_frame(samples: DataFrame, s: Selection) -> DataFrame:
    usage = materialise(res.resource_usage(samples), "resource-usage")
    return res.resource_display(usage, s.show_individual)


def report(
    spark: SparkSession, base: str, selection: Selection, store_root: str | None = None
) -> dict[str, DataFrame]:
    """Every frame of the selected runs below ``base``.

    With ``store_root`` curves, latency samples and resource usage come from the metric store, and
    only runs that it lacks, or whose files have changed, are opened.
    """
    if store_root is not None:
        curve = with_event_type(throughput_curves(spark, base, selection, store_root))
        samples = latency_samples(spark, base, selection, store_root)
        stats = lat.latency_from_store(samples, selection.start_offset_s, selection.end_offset_s)
        frames = _event_frames(curve, stats, selection)
        usage = usage_curves(spark, base, selection, store_root)
        frames["resources"] = res.resource_display(usage, selection.show_individual)
        return frames
    events = read_run_directories(spark, base, **selection.paths()).drop("logs_root")
    samples = read_resource_files(spark, base, **selection.paths()).drop("logs_root")
    frames = event_frames(events, selection)
    frames["resources"] = resource_frame(samples, selection)
    return frames


def save_report(frames: dict[str, DataFrame], path: str) -> None:
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def ingest_run_folders(
    spark: SparkSession, base: str, path: str, suffix: str = "log", **selection: Sequence[str]
) -> None:
    """Raw container logs of all selected runs into the partitioned event log, in one job.

    Logs lie in ``logs*/scenario/tech/run`` below ``base``; the run keys are taken from there.
    """
    from tidewire.sources.event_log import normalise_events, write_event_log
    from tidewire.sources.logs import parse_study_lines, read_run_logs

    lines = read_run_logs(spark, base, suffix, **selection)
    parsed = parse_study_lines(lines, [*RUN, "container_name"])
    write_event_log(normalise_events(parsed), path)


def _through_store(
    spark: SparkSession,
    base: str,
    selection: Selection,
    suffix: str,
    path: str,
    schema: str,
    compute: Callable[[DataFrame], DataFrame],
    keys: Sequence[str],
    is_valid: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Stored rows of the selected runs; ``compute`` gets the missing ones.

    The run list comes from the folders; only the folders of runs that are missing in the store,
    or whose files have changed, are opened.
    """
    pattern = run_file_glob(base, suffix, **selection.paths())
    if not any_file(spark, pattern):
        return spark.createDataFrame([], schema)
    inputs = materialise(run_inputs(spark, pattern), "run-inputs")
    return load_or_compute(spark, path, schema, inputs.select(*RUN), compute, keys, is_valid, inputs)


def _folders(base: str, selection: Selection, missing: DataFrame) -> list[str]:
    """The folders of the missing runs, and of no others."""
    root = f"{base.rstrip('/')}/{selection.logs_root}"
    return sorted("/".join([root, *(r[k] for k in RUN)]) for r in missing.select(*RUN).collect())


def _by_curve(stored: DataFrame) -> DataFrame:
    checked = curve_quality(stored, [*RUN, "event"])
    return checked.groupBy(*RUN).agg(F.bool_and("valid").alias("ok")).filter("ok").select(*RUN)


def throughput_curves(
    spark: SparkSession, base: str, selection: Selection, store_root: str
) -> DataFrame:
    """Throughput of the selected runs through the metric store."""
    schema = (
        "time_s bigint, throughput_mb_s double, scenario string, tech string, run string, event string"
    )

    def compute(missing: DataFrame) -> DataFrame:
        events = read_run_folders(spark, _folders(base, selection, missing)).drop("logs_root")
        return with_event_label(thr.throughput(events, selection.window_s))

    path = metric_path(store_root, "throughput", window_s=selection.window_s, logs=selection.logs_root)
    return _through_store(
        spark, base, selection, "parquet", path, schema, compute, [*RUN, "event"], _by_curve
    )


def latency_samples(
    spark: SparkSession, base: str, selection: Selection, store_root: str
) -> DataFrame:
    """``stored_samples`` of the selected runs through the metric store."""
    schema = (
        "segment string, time_s bigint, latency_ms bigint, weight bigint, "
        "scenario string, tech string, run string"
    )

    def compute(missing: DataFrame) -> DataFrame:
        events = read_run_folders(spark, _folders(base, selection, missing)).drop("logs_root")
        return lat.stored_samples(events).select("segment", "time_s", "latency_ms", "weight", *RUN)

    def valid(stored: DataFrame) -> DataFrame:
        """A run that reports every segment it must and has no time before its start."""
        expected = stored.filter("weight = 0").select(*RUN, "segment")
        lacking = missing_segments(stored.filter("weight > 0"), expected, RUN).select(*RUN)
        early = stored.filter("time_s < 0").select(*RUN)
        return expected.select(*RUN).distinct().join(lacking.union(early).distinct(), RUN, "left_anti")

    path = metric_path(store_root, "latency", logs=selection.logs_root)
    return _through_store(spark, base, selection, "parquet", path, schema, compute, RUN, valid)


def usage_curves(
    spark: SparkSession, base: str, selection: Selection, store_root: str
) -> DataFrame:
    """Resource usage of the selected runs through the metric store."""
    metrics = ", ".join(f"{m} double" for m in RESOURCE_METRICS)
    schema = f"time_s bigint, {metrics}, scenario string, tech string, run string"

    def compute(missing: DataFrame) -> DataFrame:
        names = missing.agg(*[F.collect_set(k).alias(k) for k in ("tech", "run")]).first()
        paths = {**selection.paths(), "techs": sorted(names["tech"]), "runs": sorted(names["run"])}
        samples = read_resource_files(spark, base, **paths).join(missing, RUN, "left_semi")
        usage = res.resource_usage(samples.drop("logs_root"))
        return usage.select("time_s", *RESOURCE_METRICS, *RUN)

    def valid(stored: DataFrame) -> DataFrame:
        first = stored.groupBy(*RUN).agg(F.min("time_s").alias("first_s"))
        return first.filter("first_s >= 0").select(*RUN)

    path = metric_path(store_root, "resources", logs=selection.logs_root)
    return _through_store(spark, base, selection, "csv", path, schema, compute, RUN, valid)


def ingest_logs(
    spark: SparkSession, log_files: str, path: str, scenario: str, tech: str, run: str
) -> None:
    """Raw container logs of a run into the partitioned event log."""
    from tidewire.sources.event_log import normalise_events, write_event_log
    from tidewire.sources.logs import parse_study_lines, read_container_logs

    parsed = parse_study_lines(read_container_logs(spark, log_files))
    keys = [F.lit(v).alias(k) for k, v in zip(RUN, (scenario, tech, run))]
    write_event_log(normalise_events(parsed.select(*keys, "*")), path)

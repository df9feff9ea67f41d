"""Metric store: computed tables as versioned Parquet, checked before reuse.

Every computation writes a version folder of its own, partitioned by run. An index names, for each
run, the version that holds its rows and the input files it was made of; it is written last, so a
run's rows change all at once and a job that dies leaves what was there. Rows of a run that the new
version lacks are gone with the old version, and a run whose result is empty is known to be so.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.plans.curves import curve_quality
from tidewire.schemas import RUN
from tidewire.session import materialise


#: What tells whether the files of a run have changed.
INPUT_FIELDS = ("n_files", "n_bytes", "changed_us")
_INDEX = "_index"
_INDEX_SCHEMA = ", ".join(
    ["version string", *[f"{c} bigint" for c in INPUT_FIELDS], *[f"{k} string" for k in RUN]]
)


def metric_path(root: str, name: str, **params: object) -> str:
    """Folder of a metric and its parameters, such as ``throughput/window_s=10``."""
    parts = [root.rstrip("/"), name, *[f"{k}={params[k]}" for k in sorted(params)]]
    return "/".join(parts)


def _index(spark: SparkSession, path: str) -> DataFrame | None:
    """``version``, input marks and run keys of every stored run."""
    try:
        return spark.read.schema(_INDEX_SCHEMA).parquet(f"{path}/{_INDEX}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _save(frame: DataFrame, path: str, keys: Sequence[str], made_of: DataFrame) -> None:
    """A new version with the rows of ``frame``, then the index of the runs in ``made_of``."""
    version = uuid.uuid4().hex
    frame.hint("rebalance", *keys).write.partitionBy(*keys).parquet(f"{path}/version={version}")
    rows = made_of.select(F.lit(version).alias("version"), *INPUT_FIELDS, *RUN)
    rows.hint("rebalance", *RUN).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(*RUN).parquet(f"{path}/{_INDEX}")


def _rows_of(spark: SparkSession, path: str, schema: str, indexed: DataFrame) -> DataFrame:
    """The stored rows of the runs in ``indexed``; other versions are not even listed.

    There are as many versions as computations whose rows are still in use.
    """
    versions = sorted(r["version"] for r in indexed.select("version").distinct().collect())
    if not versions:
        return spark.createDataFrame([], schema)
    stored = (
        spark.read.schema(f"{schema}, version string")
        .option("basePath", path)
        .parquet(*[f"{path}/version={v}" for v in versions])
    )
    return stored.join(indexed.select("version", *RUN), ["version", *RUN], "left_semi").drop("version")


def load_or_compute(
    spark: SparkSession,
    path: str,
    schema: str,
    runs: DataFrame,
    compute: Callable[[DataFrame], DataFrame],
    keys: Sequence[str] = RUN,
    is_valid: Callable[[DataFrame], DataFrame] | None = None,
    inputs: DataFrame | None = None,
) -> DataFrame:
    """Read-through: only runs without a valid stored result are computed.

    With ``inputs`` (a row per run, see ``sources.catalog.run_inputs``) a stored run also counts as
    missing if its files are no longer those it was made of. Without it a run that was stored stays
    current while it is valid.

    ``compute`` gets the missing runs and returns their rows; ``schema`` names all columns, keys
    included as strings, and ``keys`` (the run keys and others) partition them. ``is_valid`` maps
    stored rows to the run keys worth keeping; by default a curve must pass ``curve_quality``. A run
    stored without rows is valid.
    """
    check = is_valid or (lambda df: curve_quality(df, RUN).filter("valid").select(*RUN))
    # The run lists are written first, so joins on them know their size and do
    # not shuffle the events by run.
    wanted = materialise(runs.select(*RUN).distinct(), "wanted-runs")
    marks = None if inputs is None else materialise(inputs.select(*RUN, *INPUT_FIELDS), "run-inputs")
    missing = wanted
    index = _index(spark, path)
    if index is not None:
        known = index.join(wanted, RUN, "left_semi")
        if marks is not None:
            known = known.join(marks, [*RUN, *INPUT_FIELDS], "left_semi")
        known = materialise(known, "known-runs")
        stored = _rows_of(spark, path, schema, known)
        invalid = stored.select(*RUN).distinct().join(check(stored), RUN, "left_anti")
        missing = wanted.join(known.join(invalid, RUN, "left_anti"), RUN, "left_anti")
        missing = materialise(missing, "missing-runs")
    if not missing.isEmpty():
        if marks is None:
            unknown = [F.lit(None).cast("bigint").alias(c) for c in INPUT_FIELDS]
            made_of = missing.select(*RUN, *unknown)
        else:
            # The marks of before the computation: files that change meanwhile are seen next time.
            made_of = marks.join(missing, RUN, "left_semi")
        _save(compute(missing), path, keys, made_of)
    index = _index(spark, path)
    if index is None:
        return spark.createDataFrame([], schema)
    current = materialise(index.join(wanted, RUN, "left_semi"), "current-runs")
    return _rows_of(spark, path, schema, current)


def with_event_label(curve: DataFrame) -> DataFrame:
    """Stored label of the event type."""
    return curve.withColumn("event", F.lower("event_type")).drop("event_type")


def with_event_type(stored: DataFrame) -> DataFrame:
    """The event type again, from its stored label."""
    return stored.withColumn("event_type", F.initcap("event")).drop("event")


def write_client_documents(documents: DataFrame, path: str, key: str) -> None:
    """One JSON line per client, in a folder per scenario."""
    documents.hint("rebalance", key).select(key, F.col("document").alias("value")).write.mode(
        "overwrite"
    ).partitionBy(key).text(path)

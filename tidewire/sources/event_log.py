"""Event log: schema-tolerant normalisation, readers and the Parquet sink."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException, PySparkTypeError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from tidewire.functions.lenient import parse_timestamp
from tidewire.schemas import EVENT_COLUMNS, EVENT_TYPES, RUN
from tidewire.session import materialise


def _typed(df: DataFrame, name: str, kind: str) -> Column:
    """The column leniently cast, or a typed null when the file lacks it."""
    if name not in df.columns:
        return F.lit(None).cast(kind).alias(name)
    have = dict(df.dtypes)[name]
    if have == kind:
        return F.col(name)
    if kind == "timestamp":
        if have.startswith("timestamp"):
            return F.col(name).cast("timestamp").alias(name)
        return parse_timestamp(F.col(name)).alias(name)
    return F.col(name).try_cast(kind).alias(name)


def normalise_events(df: DataFrame, keys: Sequence[str] = RUN, extra: Sequence[str] = ()) -> DataFrame:
    """Seven typed columns plus the keys; only the four lifecycle stages.

    Both filters sit on bare columns, so they reach the Parquet reader.
    """
    kept = df.filter(F.col("event_type").isin(EVENT_TYPES) & F.col("message_id").isNotNull())
    return kept.select(*keys, *extra, *[_typed(df, n, t) for n, t in EVENT_COLUMNS.items()])


def run_keys_from_path(path: Column) -> list[Column]:
    """Keys from ``…/<logs root>/<scenario>/<tech>/<run>/<file>``."""
    parts = F.split(path, "/")
    return [
        F.element_at(parts, -5).alias("logs_root"),
        F.element_at(parts, -4).alias("scenario"),
        F.element_at(parts, -3).alias("tech"),
        F.element_at(parts, -2).alias("run"),
    ]


def _choice(values: Sequence[str] | None, default: str = "*") -> str:
    return default if not values else "{" + ",".join(values) + "}"


def run_file_glob(
    base: str,
    suffix: str,
    roots: Sequence[str] | None = None,
    scenarios: Sequence[str] | None = None,
    techs: Sequence[str] | None = None,
    runs: Sequence[str] | None = None,
) -> str:
    """A path pattern that lists only the selected runs."""
    return "/".join(
        [
            base.rstrip("/"),
            _choice(roots, "logs*"),
            _choice(scenarios),
            _choice(techs, "[!.]*"),
            _choice(runs),
            f"*.{suffix}",
        ]
    )


def any_file(spark: SparkSession, pattern: str) -> bool:
    """Whether a path pattern matches anything; a selection may be empty."""
    try:
        spark.read.format("binaryFile").load(pattern)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def _declared(stored: dict[str, str]) -> str:
    """Column declarations that fit how a file stores its events."""
    plain = ("string", "tinyint", "smallint", "int", "bigint", "float", "double")
    kinds = {}
    for name, wanted in EVENT_COLUMNS.items():
        have = stored.get(name, wanted)
        known = have in plain or have.startswith(("timestamp", "decimal"))
        kinds[name] = have if known else wanted
    if not kinds["timestamp"].startswith("timestamp"):
        kinds["timestamp"] = "string"
    return ", ".join(f"{n} {t}" for n, t in kinds.items())


def _footer_types(path: str) -> dict[str, str] | None:
    """Column types in a file's footer; None where the store is one that only Spark opens."""
    try:
        where, name = fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, NotImplementedError):
        return None
    found = {}
    for field in pq.read_schema(name, filesystem=where):
        try:
            found[field.name] = from_arrow_type(field.type).simpleString()
        except PySparkTypeError:
            found[field.name] = "unknown"
    return found


def stored_types(files: DataFrame) -> DataFrame:
    """``folder, path`` with ``kinds``: the columns to declare for each file, null if unknown.

    Footers are opened by the tasks, so the number of runs does not matter to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_footer_types(unquote(p)) for p in b.column(1).to_pylist()]
            kinds = [None if t is None else _declared(t) for t in found]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(kinds, pa.string())], names=["folder", "path", "kinds"]
            )

    return files.mapInArrow(run, "folder string, path string, kinds string")


def _kinds_by_spark(spark: SparkSession, path: str) -> str:
    return _declared(dict(spark.read.parquet(path).dtypes))


def read_run_directories(spark: SparkSession, base: str, **selection: Sequence[str]) -> DataFrame:
    """Events of ``logs*/scenario/tech/run`` folders, unselected runs never listed."""
    return _read_files(spark, [run_file_glob(base, "parquet", **selection)])


def read_run_folders(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """Events of the named run folders; nothing else is listed."""
    return _read_files(spark, [f"{f.rstrip('/')}/*.parquet" for f in folders])


def _read_files(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """The files of the patterns, keyed by their folders.

    The columns are declared, not merged: a column a file lacks reads as null, and a size column
    without any value (stored without a type) as null too. Files may differ in how they store
    times and sizes, also inside a run: files of equal types are read together, and all are cast
    leniently to the common types. A folder whose files agree is named to the reader as a whole.
    """
    listed = [p for p in patterns if any_file(spark, p)]
    if not listed:
        ddl = ", ".join(f"{k} string" for k in ("logs_root", *RUN))
        ddl += ", " + ", ".join(f"{n} {t}" for n, t in EVENT_COLUMNS.items())
        return spark.createDataFrame([], ddl)
    files = spark.read.format("binaryFile").load(listed).select(
        F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "path"
    )
    kinds = materialise(stored_types(files), "file-types")
    groups: dict[str, list[str]] = {}
    if kinds.where("kinds IS NULL").isEmpty():
        folders = kinds.groupBy("folder").agg(F.collect_set("kinds").alias("kinds"))
        for r in folders.where("size(kinds) = 1").collect():
            groups.setdefault(r["kinds"][0], []).append(f"{r['folder']}/*.parquet")
        mixed = folders.where("size(kinds) > 1").select("folder")
        for r in kinds.join(mixed, "folder", "left_semi").collect():
            groups.setdefault(r["kinds"], []).append(r["path"])
    else:
        # A store that tasks cannot open by themselves: Spark looks the footers up, one by one.
        for r in kinds.collect():
            found = r["kinds"] or _kinds_by_spark(spark, r["path"])
            groups.setdefault(found, []).append(r["path"])
    parts = []
    for ddl, members in sorted(groups.items()):
        raw = spark.read.schema(ddl).parquet(*sorted(members))
        keyed = raw.select("*", *run_keys_from_path(F.col("_metadata.file_path")))
        parts.append(normalise_events(keyed, ["logs_root", *RUN]))
    return reduce(DataFrame.unionByName, parts)


def write_event_log(events: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet partitioned by the run keys, so later selections prune folders.

    The rebalance step gives each run as many writers as its size asks for.
    With ``overwrite`` only the runs present in ``events`` are replaced.
    """
    events.hint("rebalance", *RUN).write.mode(mode).option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(*RUN).parquet(path)


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Events written by ``write_event_log``; key filters prune folders.

    The schema is fixed, so run names that look like numbers stay text.
    """
    ddl = ", ".join([f"{n} {t}" for n, t in EVENT_COLUMNS.items()] + [f"{k} string" for k in RUN])
    return normalise_events(spark.read.schema(ddl).parquet(path))

"""Session builder and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Shuffled bytes that a task of ``small_tasks`` reads at most, give or take a partition.
TASK_BYTES = 16 << 20
#: Partitions of its shuffles before adaptive execution joins small ones.
FINEST = 1024


def get_session(app: str = "tidewire", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on.

    On a cluster leave ``master`` unset and let spark-submit choose it.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master is not None:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Log timestamps carry no zone; they are read as UTC everywhere."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


_local_root: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The folder every executor shares, as named by ``spark.checkpoint.dir``.

    A temporary folder stands in only on a local master, as in tests.
    """
    global _local_root
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="tidewire-")
    return _local_root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; never reused between calls."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


_ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_SPLIT = "spark.sql.files.maxPartitionBytes"
_tasks_lock = threading.Lock()
#: Per session: how many steps hold ``small_tasks`` now, and what the settings were before.
_tasks_held: dict[SparkSession, tuple[int, dict[str, str | None]]] = {}


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"(\d+)([bkmgtp]?)b?", size.strip().lower()).groups()
    return int(number) << 10 * "bkmgtp".index(unit or "b")


@contextmanager
def small_tasks(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside read shuffles in tasks of ``TASK_BYTES``, files in splits of twice that.

    Rows of strings and counts take some eleven times their shuffled bytes when they are sorted and
    joined. The shuffles are cut finely first, so that a task does not grow with the input where the
    session has few shuffle partitions. Settings that are finer already are kept, and all are put
    back at the end; they bear on the size of tasks only, so a job beside it gives the same rows.
    """
    with _tasks_lock:
        depth, before = _tasks_held.get(spark, (0, {}))
        if not depth:
            before = {k: spark.conf.get(k, None) for k in (_ADVISORY, _INITIAL, _SPLIT)}
            own = before[_INITIAL] or spark.conf.get("spark.sql.shuffle.partitions")
            spark.conf.set(_ADVISORY, f"{min(TASK_BYTES, _bytes(before[_ADVISORY] or '64m'))}b")
            # A shuffle this fine is sorted by its writers, which hold the rows of a split.
            spark.conf.set(_SPLIT, f"{min(2 * TASK_BYTES, _bytes(before[_SPLIT] or '128m'))}b")
            spark.conf.set(_INITIAL, str(max(FINEST, int(own))))
        _tasks_held[spark] = depth + 1, before
    try:
        yield
    finally:
        with _tasks_lock:
            depth, before = _tasks_held[spark]
            _tasks_held[spark] = depth - 1, before
            if depth == 1:
                del _tasks_held[spark]
                for k, v in before.items():
                    if v is None:
                        spark.conf.unset(k)
                    else:
                        spark.conf.set(k, v)


_PARTITIONS = "spark.sql.shuffle.partitions"


@contextmanager
def least_partitions(spark: SparkSession, n: int) -> Iterator[None]:
    """Streams that start inside shuffle, and keep their state, in ``n`` partitions at least."""
    with _tasks_lock:
        before = spark.conf.get(_PARTITIONS, None)
        spark.conf.set(_PARTITIONS, str(max(n, int(spark.conf.get(_PARTITIONS)))))
        try:
            yield
        finally:
            if before is None:
                spark.conf.unset(_PARTITIONS)
            else:
                spark.conf.set(_PARTITIONS, before)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a compact intermediate table once and continue from the copy.

    Used where several branches need the same aggregate of a large input, so
    the input is read and shuffled once. The copy lies in the shared folder and
    outlives any executor.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

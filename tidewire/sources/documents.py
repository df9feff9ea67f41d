"""Documents as single files: written whole or not at all, and read back.

Spark's own writers name the files themselves. Here every row is a file whose name the rows give.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.schemas import RUN
from tidewire.session import materialise
from tidewire.sources.event_log import any_file

# Fixed value: the end of a client document's name.
CLIENT_SUFFIX = "_scenarioconfig.json"


def _stage(folder: str):
    """Rows of ``file, document`` to files of their own names' choice, told as ``file, staged``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        for b in batches:
            staged = []
            for document in b.column(1):
                staged.append(uuid.uuid4().hex)
                with where.open_output_stream(f"{root}/{staged[-1]}") as out:
                    out.write(document.as_buffer())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(staged, pa.string())], ["file", "staged"])

    return run


def _publish(folder: str, path: str):
    """Staged files to their names. A task that runs again finds those it moved before in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)
        _, top = fs.FileSystem.from_uri(path)
        made = set()
        for b in batches:
            for file, staged in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                target = f"{top}/{file}"
                parent = posixpath.dirname(target)
                if parent not in made:
                    where.create_dir(parent, recursive=True)
                    made.add(parent)
                try:
                    where.move(f"{root}/{staged}", target)
                except FileNotFoundError:
                    if where.get_file_info(target).type == fs.FileType.NotFound:
                        raise
            yield b

    return run


def write_documents(documents: DataFrame, path: str) -> None:
    """One file per row: ``file`` is its name below ``path``, ``document`` its text.

    ``path`` is a folder that all executors share, as a URI or an absolute path. The tasks write
    below a folder of this call, under names of their attempt; what Spark commits is the list of the
    files of the tasks that succeeded. A second job moves just those to their names, so neither a
    failed or repeated task nor a job that ends early leaves a document that is cut or stray. The
    driver sees no document and no list of them. A null text is an empty file; rows without a name
    are left out. Two rows of one name are refused before anything is published.
    """
    top = path.rstrip("/")
    folder = f"{top}/_staged-{uuid.uuid4().hex}"
    rows = documents.filter(F.col("file").isNotNull()).select(
        "file", F.coalesce("document", F.lit("")).cast("binary").alias("document")
    )
    staged = materialise(rows.mapInArrow(_stage(folder), "file string, staged string"), "staged-documents")
    try:
        twice = staged.groupBy("file").count().filter("count > 1").first()
        if twice is not None:
            raise ValueError(f"several documents are named {twice['file']}")
        staged.mapInArrow(_publish(folder, top), staged.schema).write.format("noop").mode("overwrite").save()
    finally:
        where, root = fs.FileSystem.from_uri(folder)
        if where.get_file_info(root).type != fs.FileType.NotFound:
            where.delete_dir(root)


def client_files(documents: DataFrame) -> DataFrame:
    """Client documents as files of their run's folder.

    ``documents`` has the run keys, the ``name`` of the scenario, ``client_id`` and ``document``.
    """
    container = F.concat_ws("-", "tech", "client_id")
    name = F.concat(F.concat_ws("_", "name", container), F.lit(CLIENT_SUFFIX))
    return documents.select(F.concat_ws("/", *RUN, name).alias("file"), "document")


#: Bytes of documents that a task hands on at once.
_READ_BYTES = 4 << 20


def _inside(top: str, kind: fs.FileType, ending: str = ""):
    """Folders, given below ``top``, to the folders or files directly in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(top)
        for b in batches:
            for folder in b.column(0).to_pylist():
                found = where.get_file_info(fs.FileSelector(posixpath.join(root, folder), allow_not_found=True))
                names = [i.base_name for i in found if i.type == kind and i.base_name.endswith(ending)]
                if kind == fs.FileType.File:
                    # As in Spark's readers, what starts so is no data.
                    names = [n for n in names if not n.startswith(("_", "."))]
                paths = pa.array([posixpath.join(folder, n) for n in names], pa.string())
                yield pa.RecordBatch.from_arrays([paths], ["file"])

    return run


def _contents(top: str):
    """Files, given below ``top``, with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(top)

        def batch() -> pa.RecordBatch:
            columns = [pa.array(files, pa.string()), pa.array(found, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["file", "document"])

        for b in batches:
            files, found, size = [], [], 0
            for file in b.column(0).to_pylist():
                with where.open_input_stream(posixpath.join(root, file)) as source:
                    found.append(source.read())
                files.append(file)
                size += len(found[-1])
                if size >= _READ_BYTES:
                    yield batch()
                    files, found, size = [], [], 0
            yield batch()

    return run


def _opens(path: str) -> bool:
    try:
        fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, NotImplementedError):
        return False
    return True


def read_documents(spark: SparkSession, path: str, depth: int, ending: str) -> DataFrame:
    """Files ``depth`` folders below ``path``: ``file``, the name below it, and ``document``.

    Folders are listed and files opened by the tasks, so neither the driver nor a job of its own
    goes through the files, however many there are. A store that Arrow does not open is left to
    Spark's reader.
    """
    top = path.rstrip("/")
    if not _opens(top):
        pattern = "/".join([top, *["*"] * depth, f"*{ending}"])
        if not any_file(spark, pattern):
            return spark.createDataFrame([], "file string, document string")
        parts = F.split("_metadata.file_path", "/")
        file = F.array_join(F.slice(parts, -depth - 1, depth + 1), "/").alias("file")
        return spark.read.text(pattern, wholetext=True).select(file, F.col("value").alias("document"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = spark.createDataFrame([("",)], "file string")
    for level in range(depth):
        places = places.mapInArrow(_inside(top, fs.FileType.Directory), "file string")
        if level in (0, depth - 1):
            places = places.repartition(tasks, "file")
    files = places.mapInArrow(_inside(top, fs.FileType.File, ending), "file string").repartition(tasks, "file")
    read = files.mapInArrow(_contents(top), "file string, document binary")
    return read.select("file", F.col("document").cast("string").alias("document"))


def read_client_documents(spark: SparkSession, path: str) -> DataFrame:
    """``client_files`` below ``path``, the folder of a logs root: run keys, ``file``, ``document``."""
    parts = F.split("file", "/")
    name = F.get(parts, F.lit(len(RUN)))
    return read_documents(spark, path, len(RUN), CLIENT_SUFFIX).select(
        *[F.get(parts, F.lit(i)).alias(k) for i, k in enumerate(RUN)],
        F.substring_index(name, CLIENT_SUFFIX, 1).alias("file"),
        "document",
    )

"""Token ids in compressed binary files, in ascending doc_id order.

Format: a folder of Parquet files with records of two kinds, all numbered within a shard. A shard
is a range of doc_ids; shards ascend with doc_id. ``doc`` records are the index: doc_id, first id
and number of ids of a document. ``block`` records carry up to 2048 ids as a payload of the
adaptive range coder, which starts anew in every block, and the CRC-32 of the ids as little-endian
unsigned 32-bit integers. A short block is padded with id 0 up to ``coded`` ids.

Scale: one shuffle by range brings the texts in order; a task encodes its range as a stream and
holds one group of blocks at a time. Positions across shards come from one sum per shard. Readers
deal the records by shard; a group of blocks is decoded together, each on its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm import range_coder, tokens
from tidewire.llm.common import col, give_back, text_or_empty

END = 0
BLOCK, LANES = range_coder.BLOCK, range_coder.LANES

_REST = "first bigint, n_ids bigint, coded int, ids_crc32 bigint, payload binary"
_NAMES = ["kind", "shard", "seq", "doc_id", "first", "n_ids", "coded", "ids_crc32", "payload"]


def ids_crc(ids: np.ndarray, before: int = 0) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes(), before)


def encode_group(ids: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """(ids, coded ids, CRC, payload) of the blocks of some ids; only the last may be short."""
    if len(ids) and int(ids.max()) >= 1 << 16:
        raise ValueError("this format holds ids below 65536")
    blocks = -(-len(ids) // BLOCK)
    width = BLOCK if blocks > 1 else len(ids)
    padded = np.zeros(blocks * width, np.uint16)
    padded[: len(ids)] = ids
    payloads = range_coder.encode_blocks(padded.reshape(blocks, width)) if blocks else []
    out = []
    for k, p in enumerate(payloads):
        own = ids[k * width : (k + 1) * width]
        out.append((len(own), width, ids_crc(own), p))
    return out


def _frame(kind, shard, seq, docs, first, n, coded, crc, payload, id_type) -> pa.RecordBatch:
    size = len(n)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([kind] * size, pa.string()),
            pa.array([shard] * size, pa.int32()),
            pa.array(range(seq, seq + size), pa.int64()),
            docs if docs is not None else pa.nulls(size, id_type),
            pa.array(first, pa.int64()),
            pa.array(n, pa.int64()),
            pa.array(coded, pa.int32()),
            pa.array(crc, pa.int64()),
            pa.array(payload, pa.binary()),
        ],
        names=_NAMES,
    )


def write_token_files(
    docs: DataFrame,
    tokenizer_file: str,
    path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    shards: int | None = None,
) -> None:
    """Encode every text, add the end id, and write the files to a new folder.

    A null text counts as empty and gives the end id alone. Rows of equal doc_id stand together in
    the order of their texts; null doc_ids come first. Other columns are not written. An empty
    table gives a folder without records.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        col(docs, doc_id).alias("doc_id"), text_or_empty(col(docs, text)).alias("text")
    )
    id_type = rows.schema["doc_id"].dataType.simpleString()
    ordered = (
        rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
        .withColumn("shard", F.spark_partition_id())
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer_file)
        shard, first, n_docs, n_blocks, kind_of_id = 0, 0, 0, 0, None
        held: list[np.ndarray] = []
        waiting = 0

        def blocks(everything: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, waiting, n_blocks
            ids = np.concatenate(held) if held else np.zeros(0, np.uint32)
            group = BLOCK * LANES
            upto = len(ids) if everything else len(ids) // group * group
            for a in range(0, upto, group):
                made = encode_group(ids[a : min(a + group, upto)])
                n, coded, crc, payload = zip(*made)
                yield _frame(
                    "block", shard, n_blocks, None, [None] * len(made), n, coded, crc, payload, kind_of_id
                )
                n_blocks += len(made)
            held, waiting = [ids[upto:]], len(ids) - upto

        for b in batches:
            if not b.num_rows:
                continue
            shard, kind_of_id = b.column(2)[0].as_py(), b.column(0).type
            at = 0
            for texts in tokens.in_slices(b.column(1).to_pylist()):
                ids, sizes = enc.encode(texts)
                ends = np.cumsum(sizes)
                held.append(np.insert(ids, ends, END))
                sizes = sizes + 1
                empty = [None] * len(texts)
                upto = first + np.cumsum(sizes)
                yield _frame(
                    "doc", shard, n_docs, b.column(0).slice(at, len(texts)), upto - sizes, sizes,
                    empty, empty, empty, kind_of_id,
                )
                first, n_docs, at = int(upto[-1]), n_docs + len(texts), at + len(texts)
                waiting += len(held[-1])
                if waiting >= BLOCK * LANES:
                    yield from blocks(False)
        if waiting:
            yield from blocks(True)
        held.clear()
        give_back()

    made = ordered.mapInArrow(run, f"kind string, shard int, seq bigint, doc_id {id_type}, {_REST}")
    made.write.partitionBy("kind").parquet(path)


class _Shard:
    """Documents of one shard, completed as the ids of its blocks arrive in order."""

    def __init__(self):
        self.docs: list[tuple] = []
        self.next = 0
        self.crc, self.open = 0, 0
        self.parts: list[np.ndarray] = []

    def feed(self, ids: np.ndarray, keep: bool) -> Iterator[tuple]:
        at = 0
        while at < len(ids):
            doc, first, n = self.docs[self.next]
            part = ids[at : at + n - self.open]
            self.crc = ids_crc(part, self.crc)
            if keep:
                self.parts.append(part)
            self.open += len(part)
            at += len(part)
            if self.open == n:
                whole = np.concatenate(self.parts).tolist() if keep else None
                yield doc, first, n, self.crc, whole
                self.next, self.crc, self.open, self.parts = self.next + 1, 0, 0, []


def decode_group(records: list[tuple[int, int, int, bytes]]) -> Iterator[np.ndarray]:
    """The ids of blocks of one coded length; a wrong checksum is an error."""
    rows = range_coder.decode_blocks([p for *_, p in records], records[0][1])
    for row, (n, _, crc, _) in zip(rows, records):
        ids = row[:n]
        if ids_crc(ids) != crc:
            raise ValueError("a block of token ids is damaged")
        yield ids


def read_token_files(
    spark: SparkSession, path: str, with_ids: bool = False, id_type: str = "bigint"
) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) of every document in the files.

    ``start`` counts the ids of all documents before it in all shards. ``id_type`` is the type of
    the doc_ids that were written. A folder without records gives no rows.
    """
    records = spark.read.schema(
        f"shard int, seq bigint, doc_id {id_type}, {_REST}, kind string"
    ).parquet(path)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        records.select(*_NAMES)
        .repartition(parts, "shard")
        .sortWithinPartitions("shard", F.col("kind").desc(), "seq")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = None, _Shard()
        group: list[tuple[int, int, int, bytes]] = []
        kind_of_id = None

        def flush() -> Iterator[pa.RecordBatch]:
            if not group:
                return
            done = [d for ids in decode_group(group) for d in shard.feed(ids, with_ids)]
            group.clear()
            if done:
                doc, first, n, crc, ids = zip(*done)
                arrays = [
                    pa.array(doc, kind_of_id),
                    pa.array([number] * len(doc), pa.int32()),
                    pa.array(first, pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array(crc, pa.int64()),
                ]
                names = ["doc_id", "shard", "first", "n_tokens", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

        for b in batches:
            kind_of_id = b.column(3).type
            c = {n: b.column(k).to_pylist() for k, n in enumerate(_NAMES)}
            for k in range(b.num_rows):
                if c["shard"][k] != number:
                    yield from flush()
                    number, shard = c["shard"][k], _Shard()
                if c["kind"][k] == "doc":
                    shard.docs.append((c["doc_id"][k], c["first"][k], c["n_ids"][k]))
                    continue
                if len(group) >= LANES or group and group[0][1] != c["coded"][k]:
                    yield from flush()
                group.append((c["n_ids"][k], c["coded"][k], c["ids_crc32"][k], c["payload"][k]))
        yield from flush()
        give_back()

    schema = f"doc_id {id_type}, shard int, first bigint, n_tokens bigint, ids_crc32 bigint"
    read = dealt.mapInArrow(run, schema + ", ids array<int>" * with_ids)
    # One row per shard, so the running sum over all of them is small.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        records.where("kind = 'doc'")
        .groupBy("shard")
        .agg(F.sum("n_ids").alias("n"))
        .select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    return read.join(offsets, "shard").select(
        "doc_id",
        (F.col("offset") + F.col("first")).alias("start"),
        "n_tokens",
        "ids_crc32",
        *["ids"] * with_ids,
    )

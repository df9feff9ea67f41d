"""Exact deduplication by content-defined chunk recipes.

A document becomes a recipe: the ordered list of the identifiers of its chunks, cut where a rolling
hash of the content says so. Chunks are deduplicated first: every distinct content under a digest
is brought together once, and only if no digest stands for two contents do digests serve as
identifiers (else all is cut again under another seed). After that, equal recipes mean equal
texts, so documents are compared, grouped and joined by recipe and their texts move no more.

Scale: chunks are combined by content before the shuffle, so a chunk in a third of all documents
travels once per map task. Groups of copies are aggregates with constant state. The join back to
the rows moves recipes (16 bytes per kilobyte of text); its skew is split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import as_bytes, col, text_or_empty
from tidewire.session import materialise

#: Bytes. A cut depends on the 32 bytes before it, which lie inside the chunk.
LEAST, MOST, MEAN_BITS, REACH = 256, 8192, 10, 32
_SLICE = 1 << 20


def _gear() -> np.ndarray:
    """A fixed random word per byte value, from the splitmix64 rule."""
    with np.errstate(over="ignore"):
        z = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def cut_candidates(data: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash of the last 32 bytes allows a cut."""
    found = []
    for at in range(0, len(data), _SLICE):
        begin = max(0, at - REACH)
        h = GEAR[data[begin : at + _SLICE]]
        for k in (1, 2, 4, 8, 16):
            longer = h.copy()
            longer[k:] += h[:-k] << np.uint32(k)
            h = longer
        ok = np.flatnonzero((h >> np.uint32(32 - MEAN_BITS)) == 0) + begin + 1
        found.append(ok[ok > at])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def cuts(length: int, candidates: np.ndarray) -> list[int]:
    """Ends of the chunks of one text; candidates are relative to its start."""
    out, start, i = [], 0, 0
    ends = candidates.tolist()
    while start < length:
        while i < len(ends) and ends[i] < start + LEAST:
            i += 1
        end = min(ends[i] if i < len(ends) else length, start + MOST, length)
        out.append(end)
        start = end
    return out


def chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The chunks of every text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    allowed = cut_candidates(data)
    begin = 0
    for t in texts:
        lo, hi = np.searchsorted(allowed, [begin, begin + len(t)], "right")
        ends = cuts(len(t), allowed[lo:hi] - begin)
        yield [t[a:b] for a, b in zip([0, *ends], ends)]
        begin += len(t)


def _slices(texts: list[bytes], size: int = 4 * _SLICE) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    n = 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def recipe(parts: list[bytes], seed: int) -> bytes:
    return b"".join(xxhash.xxh3_128_digest(p, seed) for p in parts)


def _recipes(rows: DataFrame, seed: int) -> DataFrame:
    @F.arrow_udf("binary")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = [recipe(c, seed) for s in _slices(as_bytes(texts)) for c in chunks(s)]
            yield pa.array(out, pa.binary())

    return rows.select("doc_id", F.sha2("text", 256).alias("text_sha256"), of("text").alias("recipe"))


def _distinct_chunks(rows: DataFrame, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in _slices(as_bytes(b.column(0))):
                distinct = {p for c in chunks(s) for p in c}
                digests = [xxhash.xxh3_128_digest(p, seed) for p in distinct]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests, pa.binary()), pa.array(list(distinct), pa.binary())],
                    names=["digest", "chunk"],
                )

    return rows.select("text").mapInArrow(run, "digest binary, chunk binary").distinct()


def verified_recipes(rows: DataFrame) -> DataFrame:
    """``doc_id, text`` to ``doc_id, text_sha256, recipe, row``, chunk digests being injective."""
    seed = 0
    while True:
        clash = _distinct_chunks(rows, seed).groupBy("digest").count().where("count > 1")
        if clash.isEmpty():
            break
        seed += 1
    return materialise(
        _recipes(rows, seed).withColumn("row", F.monotonically_increasing_id()), "recipes"
    )


def find_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row.

    Texts are equal when identical; null counts as empty, and all empty texts are one group. Of a
    group the row with the largest doc_id stays; of rows that share that doc_id exactly one stays,
    and a null doc_id ranks lowest. Other columns are not looked at. An empty table gives no rows.
    """
    rows = docs.select(
        col(docs, doc_id).alias("doc_id"), text_or_empty(col(docs, text)).alias("text")
    )
    made = verified_recipes(rows)
    groups = made.groupBy("recipe").agg(
        F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")
    )
    # Written, so that the join is between plain shuffles and a hot recipe can be split.
    return made.join(materialise(groups, "groups"), "recipe").select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        "text_sha256",
    )

"""Token counts through a digest cache.

The cache is a Parquet folder of (content digest, tokenizer digest, count). A run joins the
digests of its texts to the cache, encodes one text of every distinct digest that is missing,
appends the new counts, and joins once more to give every document its count.

Scale: copies of a text are combined before the shuffle, so a text that a third of all rows share
is encoded once and moved once per map task. The last join moves digests only; its skew is split
by adaptive execution. Appends are whole Parquet commits, so a lost executor repeats its task and
leaves nothing behind; two runs that append the same digest at once are harmless.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import tokens
from tidewire.llm.common import col, text_or_empty
from tidewire.session import materialise

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens bigint"


def content_digest(text: Column) -> Column:
    """SHA-256 of the text's UTF-8 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.encode(text_or_empty(text), "UTF-8"), 256))


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame | None:
    """One row per content digest of that tokenizer, or None where nothing is stored yet."""
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    mine = stored.where(F.col("tokenizer_digest") == version)
    return mine.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def encode_missing(texts: DataFrame, tokenizer_file: str, version: str) -> DataFrame:
    """``content_digest, text`` to rows of the cache."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer_file)
        for b in batches:
            found = [
                n for s in tokens.in_slices(b.column(1).to_pylist()) for n in enc.counts(s).tolist()
            ]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([version] * len(found), pa.string()), pa.array(found, pa.int64())],
                names=["content_digest", "tokenizer_digest", "n_tokens"],
            )

    return texts.select("content_digest", "text").mapInArrow(run, CACHE_SCHEMA)


def count_tokens(
    docs: DataFrame,
    tokenizer_file: str,
    cache_path: str,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row; new counts are appended to the cache.

    A null text counts as empty and has 0 tokens. Repeated rows each give a row. Other columns are
    not looked at. An empty table gives no rows.
    """
    spark = docs.sparkSession
    version = tokens.tokenizer_digest(tokenizer_file)
    body = text_or_empty(col(docs, text))
    rows = docs.select(
        col(docs, doc_id).alias("doc_id"), content_digest(body).alias("content_digest"), body.alias("text")
    )
    stored = read_cache(spark, cache_path, version)
    open_rows = rows if stored is None else rows.join(stored, "content_digest", "left_anti")
    missing = open_rows.groupBy("content_digest").agg(F.first("text").alias("text"))
    encode_missing(missing, tokenizer_file, version).write.mode("append").parquet(cache_path)
    # Written, so that the join is between plain shuffles and a hot digest can be split.
    known = materialise(read_cache(spark, cache_path, version), "token-counts")
    return rows.select(
        "doc_id", "content_digest", F.octet_length("text").cast("long").alias("n_bytes")
    ).join(known, "content_digest").select("doc_id", "n_bytes", "n_tokens")

"""The corpus pipeline: five stages, each working on all that its predecessor kept.

language -> near duplicates -> benchmark decontamination -> source mixing -> token files. A stage
gets the documents its predecessor wrote, applies one operator to whole texts and lets its
decisions take effect; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import decontaminate, language, mixing, near_dedup, token_files
from tidewire.llm.common import col, free_name
from tidewire.session import scratch_path, use_utc

TOKENIZER = "byte_bpe_50k.json"
#: Documents handed to a Python worker at once; all stages share the workers' memory.
BATCH = 1000


def in_small_batches(spark: SparkSession) -> None:
    """Whole texts go to the workers a thousand at a time; batches change no result."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear, learned from three quarters of the labelled ones.

    Null texts, texts without a letter and texts that two dictionaries compress nearly alike go.
    """
    in_small_batches(spark)
    fold = F.crc32(col(docs, "doc_id").cast("string")) % 4 == 2
    model = language.train(docs.where(~F.coalesce(fold, F.lit(False))))
    name = free_name(docs.columns, "language")
    found = docs.withColumn(name, language.identify(docs, "text", model))
    return found.where(~language.rejected(found[name])).select(*[col(docs, c) for c in docs.columns])


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every group of near duplicates."""
    in_small_batches(spark)
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a benchmark window."""
    in_small_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found, name = decontaminate.find_leaks(docs, benchmark)
    return found.where(F.col(name)["n_hit"] == 0).select(*[col(docs, c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from the token files."""
    in_small_batches(spark)
    path = scratch_path(spark, "token-ids")
    token_files.write_token_files(docs, public_tokenizers.path(TOKENIZER), path)
    return token_files.read_token_files(spark, path)


STAGES = [
    ("language", keep_known_language),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("token_ids", write_tokens),
]

#: Compression sizes, sketches and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    use_utc(spark)
    sf_dir = sf_dir.rstrip("/")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

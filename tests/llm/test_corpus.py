from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F
from test_decontaminate import brute as leaks
from test_mixing import brute as mixed
from test_near_dedup import brute as components
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tidewire.llm import language
from tidewire.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_and_sql(spark, name):
    problem, n = compare(spark, connect(SF), name, QUERIES[name], ORACLES[name], SF)
    assert not problem and n == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_entry_has_all():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in names if k.startswith("op")}
    assert names["pipeline"] is corpus_pipeline.run and "pipeline" not in __spark_entry__.oracle_sql()


def rows_of(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]


def check_stages(spark, docs, sf_dir, benchmark):
    """Every stage against plain Python, on what its predecessor kept."""
    stages = dict(corpus_pipeline.STAGES)
    taught = [r for r in rows_of(docs) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    model = language.train(docs.where(F.col("doc_id").isin([r[0] for r in taught])))
    scorer = language.Scorer(model)
    now = rows_of(docs)
    known = stages["language"](spark, docs, sf_dir)
    assert known.columns == docs.columns
    want = []
    for r in now:
        lang, _, margin = scorer.score(r[1])
        if lang != "und" and margin >= language.NARROW:
            want.append(r)
    assert sorted(rows_of(known), key=str) == sorted(want, key=str)

    single = stages["near_duplicates"](spark, known, sf_dir)
    assert single.columns == docs.columns
    least = {(d, c) for d, _, c in components(want)}
    keep = {d for d, c in least if d == c}
    unique = {(r[0], r[1]): r for r in want if r[0] in keep}
    assert sorted(((r[0], r[1]) for r in rows_of(single)), key=str) == sorted(unique, key=str)

    single_rows = rows_of(single)
    clean = stages["decontaminate"](spark, single, sf_dir)
    assert clean.columns == docs.columns
    want = [r for r in single_rows if leaks(r[1], benchmark)[1] == 0]
    assert sorted(rows_of(clean), key=str) == sorted(want, key=str)

    mix = stages["mix"](spark, clean, sf_dir)
    assert mix.columns == docs.columns
    copies = {}
    for (d, n, s, k), times in mixed(want)[0].items():
        copies[d] = copies.get(d, 0) + k * times
    got = rows_of(mix)
    for d in copies:
        assert sum(r[0] == d for r in got) == copies[d]

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = stages["token_ids"](spark, mix, sf_dir).orderBy("start").collect()
    start = 0
    for r, (d, t, _, _) in zip(out, sorted(got, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (d, start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def stored(df, folder):
    df.write.parquet(str(folder))
    return df.sparkSession.read.parquet(str(folder))


def test_pipeline_stages(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    check_stages(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF, items)


def test_pipeline_stages_on_odd_rows(spark, table, odd_rows, tmp_path):
    items = [(1, "nothing of this kind"), (None, None)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    taught = [(i, t, lang, s) for i, (t, lang, s) in enumerate([("the one and the two of them", "en", "a"), ("der eine und die andere", "de", None)] * 8, 300)]
    check_stages(spark, stored(table([*odd_rows, *taught]), tmp_path / "d"), str(tmp_path), items)


def test_run_and_empty_table(spark, table, tmp_path):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and set(out.columns) >= {"doc_id", "start", "n_tokens", "ids_crc32"}
    table([]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

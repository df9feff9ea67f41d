"""Sliced windows and batch assignment against their plain definitions."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.functions.payload import MIB, batch_limit
from tidewire.operators import microbatch
from tidewire.operators.microbatch import assign_batches, summarise_batches
from tidewire.operators.sliced_window import with_previous


@pytest.mark.parametrize("width", [7, 1000])
def test_previous_equals_one_window(spark, width):
    rnd = random.Random(width)
    rows = [
        (rnd.choice("ab"), rnd.choice([None, rnd.randrange(100)]), i, rnd.random()) for i in range(200)
    ]
    df = spark.createDataFrame(rows, "k string, us bigint, id bigint, v double")
    got = with_previous(df, ["k"], "us", ["id"], ["v", "us"], ordinal="nth", slice_us=width)
    w = Window.partitionBy("k").orderBy("us", "id")
    want = (
        df.withColumn("prev_v", F.lag("v").over(w))
        .withColumn("prev_us", F.lag("us").over(w))
        .withColumn("nth", F.row_number().over(w))
    )
    columns = ["id", "prev_v", "prev_us", "nth"]
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(
        map(tuple, want.select(columns).collect()), key=str
    )


def plain_batches(rows, limit):
    out, held, batch = {}, defaultdict(int), defaultdict(int)
    for key, seq, size, force in sorted(rows):
        out[(key, seq)] = batch[key]
        held[key] += size
        if held[key] >= limit or force:
            held[key], batch[key] = 0, batch[key] + 1
    return out


@pytest.mark.parametrize(
    "seed,limit,top,width,per_block",
    [(1, 50, 20, 10, 3), (2, 50, 120, 7, 2), (3, 500, 9, 5, 4), (4, 10, 1, 3, 100)],
)
def test_batches_equal_the_sequential_rule(spark, seed, limit, top, width, per_block):
    rnd = random.Random(seed)
    rows = [
        (k, i, rnd.randrange(top + 1), rnd.random() < 0.02)
        for k, n in (("a", 300), ("b", 40), ("c", 1))
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "k string, seq bigint, size bigint, force boolean")
    got = assign_batches(
        df,
        ["k"],
        ["seq"],
        "size",
        limit,
        forced=F.col("force"),
        rows_per_slice=width,
        slices_per_block=per_block,
        slice_us=37,
    )
    assert {(r["k"], r["seq"]): r["batch_id"] for r in got.collect()} == plain_batches(rows, limit)
    summary = summarise_batches(got, ["k"], "seq", "size").collect()
    assert sum(r["n_rows"] for r in summary) == len(rows)
    last = {}
    for r in summary:
        last[r["k"]] = max(last.get(r["k"], 0), r["batch_id"])
    forced = {(k, s) for k, s, _, f in rows if f}
    for r in summary:
        if r["batch_id"] < last[r["k"]]:
            assert r["n_bytes"] >= limit or (r["k"], r["published_us"]) in forced


def test_no_group_of_batch_summaries_grows_with_the_key(spark, monkeypatch):
    written = []

    def record(df, label, write=microbatch.materialise):
        written.append((label, write(df, label)))
        return written[-1][1]

    monkeypatch.setattr(microbatch, "materialise", record)
    monkeypatch.setattr(microbatch, "_FAN_IN", 3, raising=False)
    rows = [("a", i, i % 5, i % 41 == 7) for i in range(200)] + [("b", 3, 1, False)]
    df = spark.createDataFrame(rows, "k string, seq bigint, size bigint, force boolean")
    got = assign_batches(
        df, ["k"], ["seq"], "size", 23, forced=F.col("force"), rows_per_slice=5, slices_per_block=2
    )
    assert {(r["k"], r["seq"]): r["batch_id"] for r in got.collect()} == plain_batches(rows, 23)
    levels = [made.where("k = 'a'").count() for label, made in written if label in ("batch-slices", "batch-blocks")]
    assert levels == [40, 20, 7, 3, 1]


def test_batch_limit():
    assert batch_limit(1024) == 8 * MIB
    assert batch_limit(4 * MIB) == 16 * MIB

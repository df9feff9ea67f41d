"""Ranges, grids and assignments."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewire.functions.lists import endpoint_list, token_or_last, tokens
from tidewire.functions.ranges import expand_range, range_ends
from tidewire.plans import scenarios as sc
from tidewire.schemas import (
    COMMON_DIMENSIONS,
    EXCLUSIVE_COUNT,
    EXCLUSIVE_TIME,
    NETWORK_DIMENSIONS,
    RANGE_SCHEMA,
    SCENARIO_SCHEMA,
)


def stepped(lower, upper, step, op, mid=None, step2=None, op2=None):
    cur = lower - step if op == "+" else lower / step
    out = []
    while cur <= upper:
        by, how = (step2, op2) if mid and step2 and cur >= mid else (step, op)
        cur = cur + by if how == "+" else cur * by
        if cur <= upper:
            out.append(float(cur))
    return out


CASES = [
    (1, 4, 1, "+"),
    (16, 4096, 16, "*"),
    (1, 20, 1, "+", 4, 8, "+"),
    (0, 0, 250000, "+"),
    (10485760, 10485760, 16, "*"),
    (5, 4, 1, "+"),
    (0.1, 1.0, 0.1, "+"),
    (1, 100, 3, "+", 10, 2, "*"),
    (10, 100, 1, "+", 3, 20, "+"),
    (1, 5, 1, "+", 0, 3, "+"),
    (1, 5, 1, "+", 2, 0, "+"),
    (-3, 3, 2, "+"),
]


def test_ranges_equal_the_stepping_rule(spark):
    rnd = random.Random(1)
    cases = CASES + [
        (rnd.randrange(1, 9), rnd.randrange(1, 60), rnd.choice([1, 2, 0.3]), "+",
         rnd.choice([None, 5, 20]), rnd.choice([None, 2, 1.5]), rnd.choice(["+", "*"]))
        for _ in range(30)
    ]
    full = [tuple(c) + (None,) * (7 - len(c)) for c in cases]
    rows = [(i, tuple(float(x) if isinstance(x, int) else x for x in c)) for i, c in enumerate(full)]
    df = spark.createDataFrame(rows, f"id int, r {RANGE_SCHEMA.simpleString()}")
    got = {r["id"]: r["v"] for r in df.select("id", expand_range(F.col("r")).alias("v")).collect()}
    for i, c in enumerate(full):
        assert got[i] == stepped(*c), c


def test_endless_ranges_are_refused(spark):
    rows = [
        ((0.0, 5.0, 2.0, "*", None, None, None), False),
        ((1.0, 5.0, 0.0, "+", None, None, None), False),
        ((1.0, 5.0, -1.0, "+", None, None, None), True),
        ((4.0, 5.0, -1.0, "+", None, None, None), False),
        ((1.0, 5.0, 1.0, "+", 3.0, -2.0, "+"), False),
        ((1.0, 5.0, 1.0, "+", 9.0, -2.0, "+"), True),
    ]
    df = spark.createDataFrame(rows, f"r {RANGE_SCHEMA.simpleString()}, ends boolean")
    got = df.select("ends", range_ends(F.col("r")).alias("got"), "r.lower", "r.step").collect()
    # 1..5 stepping down starts above 1 but not above 5, so it never ends either.
    assert [r["got"] for r in got] == [False, False, False, False, False, True]
    with pytest.raises(Exception, match="never ends"):
        df.limit(1).select(expand_range(F.col("r"))).collect()


def test_grid_of_the_demo_scenario(spark):
    r = lambda lo, up, step, op="+": (float(lo), float(up), float(step), op, None, None, None)
    one = r(1, 1, 1)
    common = dict.fromkeys(COMMON_DIMENSIONS, one)
    common["messageSizeBytes"] = r(10485760, 10485760, 16, "*")
    network = dict.fromkeys(NETWORK_DIMENSIONS, r(0, 0, 10))
    exclusive = {EXCLUSIVE_TIME: r(30, 30, 5), EXCLUSIVE_COUNT: r(100, 100, 1)}
    row = (["round-robin"], ["shared"], tuple(common.values()), tuple(network.values()), tuple(exclusive.values()))
    df = spark.createDataFrame([row], SCENARIO_SCHEMA).withColumn("config", F.lit("demo"))
    assert [x["name"] for x in sc.scenario_grid(df, EXCLUSIVE_TIME).collect()] == ["1p1c1t10485760b-30s"]
    by_count = sc.scenario_grid(df, EXCLUSIVE_COUNT).collect()
    assert [x["name"] for x in by_count] == ["1p1c1t10485760b-100m"]
    assert by_count[0][EXCLUSIVE_TIME] is None


def scenario(spark, strategy, producers=2, consumers=3, topics=2):
    return spark.createDataFrame(
        [(1, producers, consumers, topics, strategy, 0, 64, 5, None, 10)],
        "scenario_id bigint, n_producers bigint, n_consumers bigint, n_topics bigint, consumer_strategy string, "
        "pub_rate bigint, message_size bigint, n_messages bigint, duration bigint, backlog_size bigint",
    )


@pytest.mark.parametrize(
    "strategy,want",
    [("round-robin", [["0"], ["1"], ["0"]]), ("shared", [["0", "1"]] * 3), ("random", [[]] * 3)],
)
def test_assignment(spark, strategy, want):
    rows = scenario(spark, strategy)
    assert [r["topics"] for r in sc.consumer_configs(rows).orderBy("con_id").collect()] == want
    pubs = sc.publisher_configs(rows).orderBy("pub_id").collect()
    assert [(r["pub_id"], r["topics"]) for r in pubs] == [("P0", ["0", "1"]), ("P1", ["0", "1"])]
    pairs = sc.subscription_pairs(sc.publisher_configs(rows), sc.consumer_configs(rows))
    assert pairs.count() == sum(len(t) * 2 for t in want)


def test_lists(spark):
    df = spark.createDataFrame([("a,,b,",), ("",), ("a",), (",",)], "t string")
    assert [r["x"] for r in df.select(tokens(F.col("t")).alias("x")).collect()] == [
        ["a", "", "b"], [], ["a"], [""],
    ]
    at = lambda i: token_or_last(F.col("t"), F.lit(i)).alias("x")
    assert [r["x"] for r in df.select(at(3)).collect()] == ["", "", "a", ""]
    hosts = spark.createDataFrame([(" h1,h2:1,, \th3",), (" , ",)], "t string")
    assert [r["x"] for r in hosts.select(endpoint_list(F.col("t"), "9092").alias("x")).collect()] == [
        "h1:9092,h2:1,h3:9092",
        "localhost:9092",
    ]

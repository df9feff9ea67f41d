from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.llm.sieve import may_be_in


def test_keys_pass_and_few_others(spark):
    rows = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 7 != 0, F.col("id")).alias("k"))
    keys = rows.where("id % 10 = 0").select("k")
    passed = {r["k"] for r in rows.where(may_be_in(F.col("k"), keys, "k")).select("k").collect()}
    wanted = {k if k % 7 else None for k in range(0, 20_000, 10)}
    assert wanted <= passed and len(passed) < 2 * len(wanted)
    assert rows.where(may_be_in(F.col("k"), keys.where("false"), "k")).count() == 0

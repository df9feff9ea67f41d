"""Exact order statistics from a weighted histogram.

The reported quantile is the sample at zero-based position
``round((n - 1) * q)``, halves rounded up. Raw samples are never sorted: the
input is already one row per distinct value, and ranks are found in two
steps, so no window holds more than one block of neighbouring values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def histogram_quantiles(
    hist: DataFrame,
    keys: list[str],
    value: str,
    weight: str,
    quantiles: dict[str, float],
    max_name: str,
    block: int = BLOCK,
) -> DataFrame:
    """Per key: the named quantiles of ``value`` and its maximum, as doubles.

    ``hist`` must hold one row per (keys, value); keys must not be null.
    """
    blocked = hist.withColumn("_block", F.floor(F.col(value) / block).cast("bigint"))
    totals = blocked.groupBy(*keys, "_block").agg(
        F.sum(weight).alias("_rows"), F.max(value).alias("_top")
    )
    per_key = Window.partitionBy(*keys)
    upto = per_key.orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    everything = per_key.orderBy("_block").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    placed = (
        totals.withColumn("_end", F.sum("_rows").over(upto))
        .withColumn("_n", F.sum("_rows").over(everything))
        .withColumn("_max", F.max("_top").over(everything))
        .withColumn("_start", F.col("_end") - F.col("_rows"))
    )
    rank = {
        name: F.round((F.col("_n") - 1).cast("double") * F.lit(q)).cast("bigint")
        for name, q in quantiles.items()
    }
    wanted = F.lit(False)
    for r in rank.values():
        wanted = wanted | ((r >= F.col("_start")) & (r < F.col("_end")))
    # At most one block per quantile and key survives.
    targets = placed.filter(wanted).select(*keys, "_block", "_start", "_n", "_max")
    inside = Window.partitionBy(*keys, "_block").orderBy(value).rowsBetween(
        Window.unboundedPreceding, 0
    )
    located = (
        blocked.join(targets, [*keys, "_block"])
        .withColumn("_cum", F.col("_start") + F.sum(weight).over(inside))
    )
    picks = [
        F.min(F.when(F.col("_cum") > r, F.col(value))).cast("double").alias(name)
        for name, r in rank.items()
    ]
    return located.groupBy(*keys).agg(*picks, F.max("_max").cast("double").alias(max_name))

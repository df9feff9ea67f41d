"""Previous-row values and running ordinals for long series.

A window partitioned by the series key alone would put a long series into one
task. Here every series is cut into time slices: the window runs inside a
slice, one summary row per slice carries the row count and the last row, and
the summaries alone are chained along the series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICE_US = 60_000_000
_NO_TIME = -(2**62)


def with_previous(
    df: DataFrame,
    keys: list[str],
    time_us: str,
    tie: list[str],
    carry: list[str],
    ordinal: str | None = None,
    slice_us: int = SLICE_US,
) -> DataFrame:
    """Add ``prev_<c>`` for each carried column and, if named, a 1-based ordinal.

    Rows are ordered by ``time_us`` then ``tie`` inside each key. Keys must not
    be null. With nothing to carry the slices are only counted.
    """
    order = [time_us, *tie]
    sliced = df.withColumn(
        "_slice",
        F.coalesce(F.floor(F.col(time_us) / slice_us).cast("bigint"), F.lit(_NO_TIME)),
    )
    local = Window.partitionBy(*keys, "_slice").orderBy(*order)
    chain = Window.partitionBy(*keys).orderBy("_slice")
    before = chain.rowsBetween(Window.unboundedPreceding, -1)

    here = sliced.withColumn("_rn", F.row_number().over(local))
    summary = [F.count(F.lit(1)).alias("_rows")]
    if carry:
        here = here.withColumn("_prev", F.lag(F.struct(*carry)).over(local))
        summary.append(F.max_by(F.struct(*carry), F.struct(*order)).alias("_last"))
    totals = sliced.groupBy(*keys, "_slice").agg(*summary)
    offset = F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    prior = [F.lag("_last").over(chain).alias("_prior")] if carry else []
    out = here.join(totals.select(*keys, "_slice", offset, *prior), [*keys, "_slice"])
    if carry:
        prev = F.when(F.col("_rn") == 1, F.col("_prior")).otherwise(F.col("_prev"))
        out = out.withColumn("_prev", prev).withColumns(
            {f"prev_{c}": F.col(f"_prev.{c}") for c in carry}
        )
    if ordinal is not None:
        out = out.withColumn(ordinal, F.col("_offset") + F.col("_rn"))
    return out.drop("_slice", "_rn", "_prev", "_offset", "_prior")

"""Mix sources to target weights, with DataFrame functions only.

The words of every source are summed, targets follow from the weights, a source's repetition rate
is its target over its size, and a document is emitted ``floor(rate)`` times plus one more with
probability equal to the fraction. That draw is a hash of seed and doc_id, so a rerun on any
cluster gives the same mix.

Scale: documents are summed per source before the shuffle, so a source with a third of all rows
is no hot key. Only the table of sources (one narrow row each) is ordered as a whole. It is joined
back with a plain equi-join: broadcast by Spark where it is small, else split by adaptive
execution where a source is skewed. No text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import SPACES, col, free_name

WORD = f"[^{SPACES}]+"


def word_count(text: Column) -> Column:
    """Runs of other characters than white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on seed and doc_id only."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """``source, source_size`` to ``source, source_size, target``.

    Sources in code point order, null last, take the weights in turn and share the sum of all
    sizes. A target stops at ``cap`` times its source's size and the excess is reshared by weight
    until none is above: with the sources ordered by the level at which they reach their cap, the
    level left after capping a prefix is highest where no further source needs capping, and that
    maximum is the common level.
    """
    everything = Window.partitionBy().rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")
    )
    ranked = sizes.select("source", "source_size", rank.alias("rank"), weight.alias("weight"))
    limit = F.col("source_size") * float(cap)
    before = Window.orderBy(limit / F.col("weight"), "rank").rowsBetween(
        Window.unboundedPreceding, -1
    )
    left = F.sum("source_size").over(everything) - F.coalesce(
        F.sum(F.col("source_size") * cap).over(before), F.lit(0)
    )
    left_weight = F.sum("weight").over(everything) - F.coalesce(
        F.sum("weight").over(before), F.lit(0.0)
    )
    levels = ranked.withColumn("own_level", left / left_weight)
    levels = levels.withColumn("level", F.max("own_level").over(everything))
    return levels.select(
        "source",
        "source_size",
        F.least(limit, F.col("level") * F.col("weight")).alias("target"),
    )


def plan_copies(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    cap: int = 3,
    seed: str = "mix",
) -> tuple[DataFrame, dict[str, str]]:
    """All columns of ``docs`` plus size, source size, target and number of copies.

    The second result names the added columns (a name that ``docs`` has already gets an
    underscore). A null text has no words, null is a source of its own, repeated rows are drawn
    alike, and a source without words has target 0 and no copies. An empty table stays empty.
    """
    names = {}
    for n in ("size", "source_size", "target", "copies"):
        names[n] = free_name([*docs.columns, *names.values()], n)
    sized = docs.withColumn(names["size"], word_count(col(docs, text)))
    key = free_name(sized.columns, "mix_source")
    by_source = sized.groupBy(col(sized, source).alias("source")).agg(
        F.sum(names["size"]).alias("source_size")
    )
    targets = source_targets(by_source, weights, cap).select(
        F.col("source").alias(key),
        F.col("source_size").alias(names["source_size"]),
        F.col("target").alias(names["target"]),
    )
    out = sized.join(targets, col(sized, source).eqNullSafe(targets[key]), "left").drop(key)
    size, target = F.col(names["source_size"]), F.col(names["target"])
    rate = F.when(size > 0, F.least(target / size, F.lit(float(cap)))).otherwise(F.lit(0.0))
    more = (draw(col(out, doc_id), seed) < rate - F.floor(rate)).cast("long")
    return out.withColumn(names["copies"], F.floor(rate) + more), names


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, every document as often as it is drawn."""
    planned, names = plan_copies(docs, **options)
    copy = free_name(planned.columns, "copy")
    copies = F.col(names["copies"])
    emitted = planned.where(copies > 0).withColumn(
        copy, F.explode(F.sequence(F.lit(1).cast("long"), copies))
    )
    return emitted.select(*[col(emitted, c) for c in docs.columns])

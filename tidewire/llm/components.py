"""Connected components of an edge table, by smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.session import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """``a, b`` to ``node, label`` with the smallest node that each node can reach.

    A round takes the smallest label of all neighbours (combined before the shuffle, so a hub is
    no hot key) and then the label of that label, so long chains shorten fast. Every round is
    written to the shared folder; the driver sees one count per round.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialise(both.distinct(), "edges")
    labels = materialise(
        both.groupBy("a").agg(F.min("b").alias("b")).select(
            F.col("a").alias("node"), F.least("a", "b").alias("label")
        ),
        "labels",
    )
    while True:
        near = (
            both.join(labels, F.col("b") == F.col("node"))
            .groupBy("a")
            .agg(F.min("label").alias("near"))
            .select("a", "near")
        )
        new = labels.join(near, F.col("node") == F.col("a"), "left").select(
            "node",
            F.col("label").alias("was"),
            F.least("label", F.coalesce("near", "label")).alias("best"),
        )
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("further"))
        labels = materialise(
            new.join(jump, F.col("best") == F.col("via"), "left").select(
                "node", "was", F.least("best", F.coalesce("further", "best")).alias("label")
            ),
            "labels",
        )
        if labels.where("label != was").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")

"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for each node of ``a, b`` edges; the label is the component's lowest node.

    Every round takes the lowest label among the neighbours and then the label of that label,
    so long chains halve. Tables between rounds are written to the shared folder.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    labels = stored(labels.select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "node", "left").select(
            "node", F.col("label").alias("before"), F.least("label", F.coalesce("near", "label")).alias("label")
        )
        roots = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = stored(
            lower.join(roots, "label", "left").select(
                "node", "before", F.least("label", F.coalesce("root", "label")).alias("label")
            ),
            "labels",
        )
        labels = jumped.select("node", "label")
        if jumped.where(F.col("before") != F.col("label")).isEmpty():
            return labels

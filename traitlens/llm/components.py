"""Connected components of an edge table by smallest labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitlens.llm.common import settle


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of (a, b) edges; the component is its smallest node.

    Each round takes the smallest label among a node and its neighbours, then the
    label of that label, so chains shorten by more than half.  Counts of changed
    labels are all the driver sees.  Sums over a hub's neighbours are reduced
    before they are shuffled; adaptive execution splits a hub in the joins.
    """
    both = settle(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = settle(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")))
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        closer = labels.join(near, "a", "left").select("a", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        of_label = labels.select(F.col("a").alias("label"), F.col("label").alias("further"))
        jumped = closer.join(of_label, "label", "left").select("a", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        found = settle(jumped)
        labels = found.select("a", "label")
        if found.where("label <> old").isEmpty():
            return labels.select(F.col("a").alias("node"), F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")

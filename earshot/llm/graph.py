"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dealt


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in ``edges`` (a, b), label the smallest node reachable.

    Each round takes the smallest label among a node and its neighbours, ends if that
    changes nothing, and else takes the label of that label, so chains halve. Labels
    are checkpointed each round; only whether one changed reaches the driver.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
    while True:
        near = both.join(dealt(labels), F.col("b") == F.col("node")).select(F.col("a").alias("node"), "label", F.lit(None).cast("long").alias("old"))
        own = labels.select("node", "label", F.col("label").alias("old"))
        step = cut(near.union(own).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old")))
        if step.where(F.col("label") != F.col("old")).isEmpty():
            return labels
        ahead = step.select(F.col("node").alias("at"), F.col("label").alias("ahead"))
        jumped = step.join(dealt(ahead), F.col("label") == F.col("at")).select("node", F.least("label", "ahead").alias("label"))
        labels = cut(jumped)

"""Connected components of an edge table by label hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) to rows (node, component): component is the least node that edges connect the node with.

    Each round takes the least label among neighbours and then the label of that
    label, so a path of length n ends in about log n rounds. Only counts reach
    the driver; each round is a written table. Loops and repeated edges are
    harmless; nodes without edges do not occur.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("low"))
        hooked = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("component").alias("old"), F.least("component", "low").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("further"))
        after = written(hooked.join(jump, "low", "left").select("node", "old", F.coalesce("further", "low").alias("component")))
        labels = after.select("node", "component")
        if after.filter("old <> component").isEmpty():
            return labels

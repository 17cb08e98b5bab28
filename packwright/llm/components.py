"""Connected components as Spark jobs: least labels, with pointer jumping, until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import released
from .files import staged_lean as stored


def components(edges: DataFrame) -> DataFrame:
    """node, component of edges(a, b): component is the smallest node reachable.

    Each round takes the least label among the neighbours and then the label of that label, so the
    number of rounds grows with the logarithm of the longest path.  Labels are written to the shared
    folder each round, and the last round's are deleted.  Self-links and repeated edges are harmless; nodes without an edge have no row.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    both = stored(both.distinct(), "links")
    labels = stored(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("component")), "labels")
    last = labels
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        nearer = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jumps = labels.select(F.col("node").alias("component"), F.col("component").alias("jump"))
        moved = stored(nearer.join(jumps, "component").select("node", "old", F.least("component", "jump").alias("component")), "labels")
        released(last)
        labels, last = moved.drop("old"), moved
        if moved.where("old <> component").isEmpty():
            released(both)
            return labels

"""Connected components of an edge table, by contraction rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b: long); a component is its smallest node.

    A round hooks each node to its smallest neighbour and contracts the edges by that; the
    number of nodes left falls at least by half. Rounds end in stored tables, so no lineage
    grows and nothing but row counts reaches the driver. A hub's edges are reduced to one
    minimum before they are shuffled and spread again by a splittable join.
    """
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    pairs, labels = stored(pairs, "edges"), None
    while not pairs.isEmpty():
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
        hook = stored(hook, "hooks")
        # follow the hooks one step, so that short chains collapse in this round
        step = hook.select(F.col("node").alias("to"), F.col("to").alias("far"))
        hook = stored(hook.join(step, "to", "left").select("node", F.coalesce("far", "to").alias("to")), "hooks")
        left = hook.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        right = hook.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = pairs.join(left, "a").select("b", "ta").join(right, "b").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
        pairs = stored(moved.where("a < b").distinct(), "edges")
        if labels is None:
            labels = hook.withColumnRenamed("to", "component")
        else:
            later = hook.select(F.col("node").alias("component"), "to")
            labels = stored(labels.join(later, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
    if labels is None:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels

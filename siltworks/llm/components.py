"""Connected components of an edge table by contraction to least neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import cut


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, label): label is the smallest node reachable; nodes are those with an edge.

    Each round maps every node to its least neighbour's least neighbour and
    contracts the edges, so that a round's joins see only edges that still lie
    between different labels.  Counts are combined before they are shuffled.  No
    edges, or only loops: an empty table, or the loops' nodes.
    """
    left = cut(edges.select(F.least(u, v).cast("long").alias("a"), F.greatest(u, v).cast("long").alias("b")).distinct())
    labels = None
    while True:
        ends = left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("least")).unionAll(left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")))
        near = ends.groupBy("node").agg(F.min("least").alias("least")).select("node", F.least("node", "least").alias("to"))
        far = near.select(F.col("node").alias("to"), F.col("to").alias("far"))
        step = cut(near.join(far, "to").select("node", F.least("to", "far").alias("to")))
        labels = step.withColumnRenamed("to", "label") if labels is None else cut(labels.join(step.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        moved = left.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        left = cut(moved.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if left.isEmpty():
            return labels

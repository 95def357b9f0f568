"""Walks over parent-child tables, level by level, and span overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.operators.ordered import written

#: Levels that one round of a walk goes.
STRIDE = 8


def _climbed(edges: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, top, up) of nodes with one parent, and (node) of the tops: roots, and nodes with none or several.

    ``top`` is the nearest one above, ``up`` steps away.  Steps are doubled each round, so the rounds grow with the logarithm of
    the longest chain; what has no top above lies below a cycle that nothing leads into, and is left out.
    """
    parents = edges.groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("at"), F.max("parent").alias("most"))
    single = parents.filter("at = most").select("node", "at").join(roots, "node", "left_anti")
    single = written(single)
    above = written(edges.select(F.col("parent").alias("node")).unionAll(edges.select("child")).unionAll(roots.select("node")).distinct().join(single, "node", "left_anti"))
    # ``done``: what stands at ``at`` is a top.
    rows = written(single.join(above.select(F.col("node").alias("at"), F.lit(True).alias("done")), "at", "left").select("node", "at", F.lit(1).alias("up"), F.coalesce("done", F.lit(False)).alias("done")))
    settled, left = [rows.filter("done")], rows.filter("not done")
    while not left.isEmpty():
        known = settled[0]
        for x in settled[1:]:
            known = known.unionAll(x)
        to = known.unionAll(left).select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("up").alias("more"), F.col("done").alias("ends"))
        rows = written(left.drop("done").join(to, "at").select("node", F.col("next").alias("at"), (F.col("up") + F.col("more")).alias("up"), F.col("ends").alias("done")))
        ended = rows.filter("done")
        if ended.isEmpty():
            break
        settled, left = [*settled, ended], rows.filter("not done")
    whole = settled[0]
    for x in settled[1:]:
        whole = whole.unionAll(x)
    return whole.select("node", F.col("at").alias("top"), "up"), above


def reach(edges: DataFrame, roots: DataFrame, stride: int = STRIDE) -> DataFrame:
    """(node, level): all that is reachable from ``roots`` (node) over ``edges`` (parent, child), each node at its least level, roots at 0.

    A node with one parent lies one level below it, so chains of such nodes are climbed by doubling (``_climbed``) and the walk itself goes
    only over tops, where several parents meet: a step leads from a top to one that a node below it is a parent of.  A round goes
    ``stride`` steps on from the tops that the last one reached or brought nearer, and is written; the walk ends when a round brings
    nothing new, whatever the depth, so cycles end it too.  Null nodes are no nodes.
    """
    kept = written(edges.select("parent", "child").filter("parent is not null and child is not null"))
    front = written(roots.select("node").filter("node is not null").distinct().withColumn("level", F.lit(0)))
    below, above = _climbed(kept, front.select("node"))
    met = above.join(front, "node", "left_anti").join(kept.select(F.col("child").alias("node"), "parent"), "node")
    spots = below.unionAll(above.select("node", F.col("node").alias("top"), F.lit(0).alias("up")))
    steps = met.withColumnRenamed("node", "to").join(spots.withColumnRenamed("node", "parent"), "parent")
    steps = written(steps.groupBy("top", "to").agg((F.min("up") + 1).alias("far")))
    seen = front
    while not front.isEmpty() and not steps.isEmpty():
        level, found = front, None
        for _ in range(stride):
            level = level.join(steps, level["node"] == steps["top"]).groupBy(F.col("to").alias("node")).agg(F.min(F.col("level") + F.col("far")).alias("level"))
            found = level if found is None else found.unionAll(level)
        least = found.groupBy("node").agg(F.min("level").alias("level"))
        front = written(least.join(seen.withColumnRenamed("level", "held"), "node", "left").filter("held is null or level < held").select("node", "level"))
        if not front.isEmpty():
            seen = written(seen.unionAll(front).groupBy("node").agg(F.min("level").alias("level")))
    under = below.join(seen.withColumnRenamed("node", "top"), "top").select("node", (F.col("level") + F.col("up")).alias("level"))
    return seen.unionAll(under)


def descendants(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(node, level) reachable from ``roots`` (node) over ``edges`` (parent, child) in at most ``depth`` steps, roots at 0.

    Levels are joins of one lazy plan; a node keeps its least level, so cycles end at
    the depth.
    """
    level = roots.select("node").distinct().withColumn("level", F.lit(0))
    found = level
    for n in range(1, depth + 1):
        level = level.join(edges, level["node"] == edges["parent"]).select(F.col("child").alias("node")).distinct().withColumn("level", F.lit(n))
        found = found.unionByName(level)
    return found.groupBy("node").agg(F.min("level").alias("level"))


def breadcrumbs(edges: DataFrame, leaves: DataFrame, depth: int) -> DataFrame:
    """(leaf, path): ancestors of each leaf (node), from the root down, without the leaf."""
    up = leaves.select(F.col("node").alias("leaf"), F.col("node").alias("at"), F.array().cast("array<string>").alias("path"))
    for _ in range(depth):
        up = up.join(edges, up["at"] == edges["child"], "left").select("leaf", F.col("parent").alias("at"), F.when(F.col("parent").isNull(), F.col("path")).otherwise(F.concat(F.array(F.col("parent").cast("string")), "path")).alias("path"))
    return up.select("leaf", "path")


def overlaps(blocks: DataFrame, spans: DataFrame, key: str, width: int) -> DataFrame:
    """Blocks (key, b_start, b_end) with the spans (key, s_start, s_end) of the same key that they overlap, half open.

    Both sides are laid out in cells of ``width``; the pair is made in the first
    cell that both have, so it is an equi-join and no pair comes twice.
    """
    cells = lambda a, b: F.sequence(F.floor(F.col(a) / width), F.floor((F.greatest(F.col(b), F.col(a) + 1) - 1) / width))
    left = blocks.withColumn("cell", F.explode(cells("b_start", "b_end")))
    right = spans.withColumn("cell", F.explode(cells("s_start", "s_end")))
    first = F.floor(F.greatest("b_start", "s_start") / width)
    return left.join(right, [key, "cell"]).filter((F.col("b_start") < F.col("s_end")) & (F.col("b_end") > F.col("s_start")) & (F.col("cell") == first)).drop("cell")

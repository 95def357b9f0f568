"""Ranks, running sums, runs and percentiles of keys that may hold most of the rows.

A window over such a key is one task.  Here rows are sorted by range over all partitions,
key first, and written once, so that the split is the same for all that follows.  What a partition can't
know by itself, the rows of its keys in earlier partitions and the last row before its first, comes from a table
with a row for each key and partition, which is joined back.  A window sees one key in one partition.

Defined cases: null keys are a key of their own, and null values sort as their order says; rows that are
equal in the order are ranked in either way, so give an order without ties where that matters; columns keep their
names, helpers get names that no column has; an empty table gives an empty one.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the cluster's shared checkpoint folder, read back: they are worked out once, and their lineage ends."""
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        folder = spark.sparkContext.getCheckpointDir()
    path = f"{folder}/ordered-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, longer by underscores until no column is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def meet(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on equal values or nulls; the columns of ``on`` stay once."""
    own = {c: f"{c}__{uuid.uuid4().hex[:8]}" for c in on}
    other = right.select(*[F.col(c).alias(own.get(c, c)) for c in right.columns])
    same = F.lit(True)
    for c in on:
        same = same & left[c].eqNullSafe(other[own[c]])
    return left.join(other, same, how).drop(*own.values())


#: Rows that one task sorts or aggregates at once, about.
TASK_ROWS = 500_000


def parts(*rows: int, each: int | None = None) -> int:
    """Parts for a shuffle of so many rows, of about ``TASK_ROWS`` each, or as many as given.

    Named in ``repartition``, a number of parts stays: parts that Spark chooses are put together by compressed size, as
    few as there are cores, so that what a task sorts grows with the input.
    """
    return max(1, -(-sum(rows) // (each or TASK_ROWS)))


#: Parts that the rows of a key are dealt into where a join makes their product with another side.
PARTS = 64


def dealt_left(left: DataFrame, right: DataFrame, on: str, other: str) -> DataFrame:
    """A left join on ``on`` = ``other`` of few keys with many rows on both sides: what a key makes is the product of them, so its rows of ``left`` are
    dealt into ``PARTS`` parts and those of ``right`` copied to each.  The partitions are stated, as small inputs that make many rows would else be put together.
    """
    part, copy = fresh(left.crossJoin(right), "part_", "copy_")
    dealt = left.withColumn(part, F.pmod(F.xxhash64(*left.columns), F.lit(PARTS)).cast("int"))
    dealt = dealt.repartition(max(PARTS, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))), on, part)
    copied = right.withColumn(copy, F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return dealt.join(copied.hint("shuffle_merge"), (dealt[on] == copied[other]) & (dealt[part] == copied[copy]), "left").drop(part, copy)


class Placed:
    """Rows sorted over all partitions: ``rows`` with a place that grows in the order, and the partition."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[Column]):
        self.keys = keys
        self.at, self.part, self.first, self.before, self.total, self.was = fresh(df, "at", "part", "first", "before", "total", "was")
        by = [F.col(k) for k in keys] + order
        placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(self.at, F.monotonically_increasing_id())
        self.rows = written(placed.withColumn(self.part, F.shiftright(self.at, 33)))
        self.inner = Window.partitionBy(*keys, self.part).orderBy(self.at)
        self.outer = Window.partitionBy(*keys).orderBy(self.part)

    def offsets(self, rows: DataFrame, n: Column) -> DataFrame:
        """Keys, part, first place, the sum of ``n`` in earlier parts, and over all."""
        parts = rows.groupBy(*self.keys, self.part).agg(F.min(self.at).alias(self.first), n.alias("n_"))
        earlier = F.coalesce(F.sum("n_").over(self.outer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return parts.select(*self.keys, self.part, self.first, earlier.alias(self.before), F.sum("n_").over(Window.partitionBy(*self.keys)).alias(self.total))


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the row's number within its key, from 1 on: its place in its partition, and the rows of its key in those before."""
    p = Placed(df, keys, order)
    known = meet(p.rows, p.offsets(p.rows, F.count("*")), [*keys, p.part])
    return known.select(*df.columns, (F.col(p.at) - F.col(p.first) + F.col(p.before) + 1).alias(name))


def running(df: DataFrame, keys: list[str], order: list[Column], size: Column, name: str = "before", total: str | None = None) -> DataFrame:
    """Adds the sum of ``size`` over the rows of the key that come before, and over all of them as ``total``."""
    own = fresh(df, "size")[0]
    p = Placed(df.withColumn(own, F.coalesce(size, F.lit(0))), keys, order)
    inside = F.coalesce(F.sum(own).over(p.inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = meet(p.rows.withColumn(p.was, inside), p.offsets(p.rows, F.sum(own)), [*keys, p.part])
    return known.select(*df.columns, (F.col(p.was) + F.col(p.before)).alias(name), *([F.col(p.total).alias(total)] if total else []))


def runs(df: DataFrame, keys: list[str], order: list[Column], same: Callable[[Column], Column], name: str = "run") -> DataFrame:
    """Adds a number, from 1 on, that grows where ``same`` (of the row before, as a struct; null is no) fails.

    The first row of a key in a partition is held against the last row of that key in an earlier one, so runs go on over edges.
    """
    p = Placed(df, keys, order)
    row = F.struct(*[F.col(c) for c in df.columns])
    ends = p.rows.groupBy(*keys, p.part).agg(F.min(p.at).alias(p.first), F.max_by(row, p.at).alias("last_"))
    edges = ends.select(*keys, p.part, F.lag("last_").over(p.outer).alias(p.before))
    known = meet(p.rows.withColumn(p.was, F.lag(row).over(p.inner)), edges, [*keys, p.part])
    opens = F.when(F.coalesce(same(F.coalesce(F.col(p.was), F.col(p.before))), F.lit(False)), 0).otherwise(1)
    marked = written(known.select(*df.columns, p.at, p.part, opens.alias(p.total)))
    sums = p.offsets(marked.withColumnRenamed(p.total, "opens_"), F.sum("opens_"))
    local = F.sum(p.total).over(p.inner)
    return meet(marked.withColumn(p.was, local).drop(p.total), sums, [*keys, p.part]).select(*df.columns, (F.col(p.was) + F.col(p.before)).alias(name))


def percentiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Keys and, for each name in ``at``, the percentile interpolated between neighbours; nulls don't count, and a key without values has no row.

    Equal values are counted before they are sorted; each value knows the places it takes, so no list of values is held.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n__"))
    placed = running(counts, keys, [F.col(value).asc()], F.col("n__"), "before__", "total__")
    inside = lambda k: (F.col("before__") <= k) & (k < F.col("before__") + F.col("n__"))
    out = []
    for name, p in at.items():
        k = (F.col("total__") - 1) * F.lit(float(p))
        low, high = F.max(F.when(inside(F.floor(k)), F.col(value))), F.max(F.when(inside(F.ceil(k)), F.col(value)))
        out.append((low + (high - low) * (F.max(k) - F.floor(F.max(k)))).alias(name))
    return placed.groupBy(*keys).agg(*out)

"""Latest, first-seen, winner, runs and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key: the first in that order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).filter("_n = 1").drop("_n")


def latest(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """The newest row of each key by max_by, which is combined map-side; ties go to the larger ``tie``."""
    rest = [c for c in df.columns if c != key]
    newest = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("_row"))
    return newest.select(key, *[F.col("_row")[c].alias(c) for c in rest])


def first_seen(df: DataFrame, key: Column, order: str) -> DataFrame:
    """Rows whose key no earlier row has; rows with a null key stay."""
    keyed = df.withColumn("_key", key)
    n = F.row_number().over(Window.partitionBy("_key").orderBy(order))
    with_key = keyed.filter("_key is not null").withColumn("_n", n).filter("_n = 1").drop("_n", "_key")
    return with_key.unionByName(keyed.filter("_key is null").drop("_key"))


def runs(df: DataFrame, keys: list[str], order: list[str], same: Column) -> DataFrame:
    """Adds ``run``: its number grows where ``same`` (null: no) fails for a row and the one before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def neighbours(df: DataFrame, keys: list[str], index: str, item: Column, reach: int) -> Column:
    """Items whose index lies within ``reach`` of the row's, by value, in order."""
    w = Window.partitionBy(*keys).orderBy(index).rangeBetween(-reach, reach)
    return F.sort_array(F.collect_list(F.struct(F.col(index).alias("i"), item.alias("item"))).over(w))

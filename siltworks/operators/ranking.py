"""Merging ranked hits and sets of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.operators.ordered import ranked

RRF_K = 60


def combine(hits: DataFrame, how: str, buckets: list[str], weights: dict[str, float] | None = None, optional: frozenset[str] = frozenset()) -> DataFrame | None:
    """(bucket, id, score) to (id, score).  AND: ids in every bucket; other ways: in any.

    The score sums each bucket's best score, times its weight (1 if it has none) for
    LINEAR; RRF sums 1 / (60 + rank) of (score descending, id).  Under AND, empty
    buckets that are ``optional`` don't count; if all are such, None: no filter.
    """
    best = hits.filter(F.col("bucket").isin(buckets)).groupBy("bucket", "id").agg(F.max("score").alias("score"))
    if how == "RRF":
        # A bucket may hold most of the hits, so no window is laid over it.
        best = ranked(best, ["bucket"], [F.col("score").desc(), F.col("id")], "place").select("bucket", "id", (1 / (RRF_K + F.col("place"))).alias("score"))
    if how == "LINEAR" and weights:
        pairs = F.create_map(*[F.lit(x) for k in weights.items() for x in k])
        best = best.withColumn("score", F.col("score") * F.coalesce(F.try_element_at(pairs, F.col("bucket")), F.lit(1.0)))
    needed = len(buckets)
    if how == "AND" and optional:
        held = {r["bucket"] for r in best.filter(F.col("bucket").isin(list(optional))).select("bucket").distinct().collect()}
        needed = len([b for b in buckets if b not in optional or b in held])
        if not needed:
            return None
    merged = best.groupBy("id").agg(F.sum("score").alias("score"), F.count("*").alias("n_buckets"))
    return (merged.filter(F.col("n_buckets") == needed) if how == "AND" else merged).select("id", "score")


def merge_hits(hits: DataFrame) -> DataFrame:
    """(query, id, score) to one row for each id: its best score and the queries that found it."""
    return hits.groupBy("id").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("query")).alias("queries"))


def first_wins(parts: list[DataFrame], key: str) -> DataFrame:
    """Union in which the first part that has a key gives its row."""
    rows = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    union = rows[0]
    for r in rows[1:]:
        union = union.unionByName(r)
    rest = [c for c in parts[0].columns if c != key]
    best = union.groupBy(key).agg(F.min(F.struct("_part", *rest)).alias("_row"))
    return best.select(key, *[F.col("_row")[c].alias(c) for c in rest])

"""Tag-driven retrieval: layers that resolve tags to targets, their combination, and filters by tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.operators import vectors
from siltworks.operators.ranking import combine

LAYERS = ("l1", "l1.5", "l4")
SEMANTIC_THRESHOLD = 0.75


def parse_strategy(strategy: str) -> tuple[str, ...]:
    """Known layers of "l1|l1.5|l4", in the order of layers; unknown names are passed over."""
    asked = {t.strip().lower() for t in strategy.split("|")}
    return tuple(x for x in LAYERS if x in asked)


def exact(index: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """(bucket, id, score 1): rows of ``index`` (tag_type, ``column``, target_id) that a row of ``wanted`` (bucket, tag_type, value) names."""
    w = wanted.select("bucket", F.col("tag_type").alias("_type"), F.col("value").alias("_value")).distinct()
    met = index.join(w, (index["tag_type"] == w["_type"]) & (index[column] == w["_value"]))
    return met.select("bucket", F.col("target_id").alias("id"), F.lit(1.0).alias("score"))


def semantic(index: DataFrame, wanted: DataFrame, threshold: float = SEMANTIC_THRESHOLD, k: int = 50) -> DataFrame:
    """(bucket, id, score): for each row of ``wanted`` (bucket, tag_type, value, probe) the ``k`` targets of its type whose vectors are nearest.

    One search over all types at once would mix them, so ``tag_type`` is part of what is searched: a type is a search of its own.
    """
    kinds = sorted(r["tag_type"] for r in wanted.select("tag_type").distinct().collect())  # a request's types: a handful
    found = None
    for kind in kinds:
        probes = wanted.filter(F.col("tag_type") == kind).select(F.struct("bucket", "value").alias("query"), "probe")
        hits = vectors.search(index.filter((F.col("tag_type") == kind) & F.col("embedding").isNotNull()), probes, threshold, k, id="target_id")
        hits = hits.select(F.col("query.bucket").alias("bucket"), "id", "score")
        found = hits if found is None else found.unionByName(hits)
    return found if found is not None else exact(index, wanted, "tag_value").filter("false")


def resolve(index: DataFrame, wanted: DataFrame, strategy: str, how: str, weights: dict[str, float] | None = None, optional: frozenset[str] = frozenset()) -> DataFrame | None:
    """(id, score) of targets by the layers of ``strategy``: the best score of each bucket and target, then combined.

    None: all buckets are optional and empty, so there is no filter.
    """
    layers = parse_strategy(strategy)
    parts = [exact(index, wanted, c) for layer, c in (("l1", "tag_value"), ("l1.5", "tag_value_normalized")) if layer in layers]
    parts += [semantic(index, wanted)] if "l4" in layers else []
    if not parts:
        raise ValueError(f"no known layer in {strategy!r}")
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    buckets = sorted(r["bucket"] for r in wanted.select("bucket").distinct().collect())  # a request's buckets: a handful
    return combine(hits, how, buckets, weights, optional)


def within(rows: DataFrame, column: str, ids: DataFrame | None) -> DataFrame:
    """Rows whose ``column`` is among ``ids`` (id): none for an empty set, all for None."""
    if ids is None:
        return rows
    chosen = ids.select(F.col("id").alias("_chosen")).distinct()
    return rows.join(chosen, rows[column] == chosen["_chosen"], "left_semi")

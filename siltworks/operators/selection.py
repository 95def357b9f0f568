"""Reranking, budgets, expansions, recall and reads of subtrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.operators.ordered import ranked
from siltworks.operators.trees import reach


def page(rows: DataFrame, *order: Column, limit: int = 50, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def rerank(rows: DataFrame, score: str, rank: str, ordered: bool = False, on: bool = True, how: str | None = None) -> DataFrame:
    """By score, best first, ties as they were; left as they were if an order was asked for, it is off, or hits are combined by AND or OR."""
    if ordered or not on or how in ("AND", "OR"):
        return rows.orderBy(rank)
    return rows.orderBy(F.col(score).desc_nulls_last(), rank)


def reranked(rows: DataFrame, keys: list[str], score: str, rank: str, ordered: bool = False, on: bool = True, how: str | None = None) -> DataFrame:
    """The hits of many requests (keys) with ``place``, from 1 on, in the order that ``rerank`` gives one request's; requests may be of any size."""
    as_they_were = ordered or not on or how in ("AND", "OR")
    order = [F.col(rank).asc()] if as_they_were else [F.col(score).desc_nulls_last(), F.col(rank).asc()]
    return ranked(rows, keys, order, "place")


def within_budget(rows: DataFrame, key: str, score: str, id: str, size: str, items: int = 6, total: int = 3200) -> DataFrame:
    """(key, id, score, size, place) chosen greedily by score, ties by id: an item that doesn't fit is passed over, the first always fits.

    Blank items (size 0 or null) don't count.  A key's ids and sizes, not its texts, are folded, in the JVM.
    """
    best = rows.filter(F.col(size) > 0).groupBy(key).agg(F.sort_array(F.collect_set(F.struct((-F.col(score)).alias("s"), F.col(id).alias("id"), F.col(size).cast("long").alias("n")))).alias("all"))
    chosen = F.filter("all", lambda x: F.lit(False))
    start = F.struct(F.lit(0).cast("long").alias("used"), chosen.alias("chosen"))

    def step(a: Column, x: Column) -> Column:
        fits = (F.size(a["chosen"]) < items) & ((F.size(a["chosen"]) == 0) | (a["used"] + x["n"] <= total))
        return F.struct((a["used"] + F.when(fits, x["n"]).otherwise(0)).alias("used"), F.when(fits, F.concat(a["chosen"], F.array(x))).otherwise(a["chosen"]).alias("chosen"))

    picked = best.select(key, F.posexplode(F.aggregate("all", start, step, lambda a: a["chosen"])).alias("place", "x"))
    return picked.select(key, F.col("x.id").alias(id), (-F.col("x.s")).alias(score), F.col("x.n").alias(size), "place")


def clip_expansions(items: list[str], original: str, most: int) -> list[str]:
    """Without repeats and without the original, in order, ``most`` at most."""
    return [x for x in dict.fromkeys(items) if x != original.strip()][:most]


def expand_terms(terms: list[str], synonyms: dict[str, list[str]]) -> list[str]:
    """The terms with what stands for them, each once, in order."""
    return list(dict.fromkeys(x for t in terms for x in (t, *synonyms.get(t, []))))


def recall_at(exact: DataFrame, found: DataFrame) -> DataFrame:
    """(query, recall): share of each query's exact ids (query, id) that ``found`` (query, id) has; queries without exact ids are left out."""
    pairs = exact.select("query", "id").distinct()
    held = found.select("query", "id").distinct().withColumn("held", F.lit(1))
    return pairs.join(held, ["query", "id"], "left").groupBy("query").agg((F.count("held") / F.count("*")).alias("recall"))


def subtree(edges: DataFrame, root: str) -> DataFrame:
    """(node) below and at ``root`` over ``edges`` (parent, child), to the end; nodes already seen end a walk."""
    return reach(edges, edges.sparkSession.createDataFrame([(root,)], "node string")).select("node")


def confidence(base: Column, *losses: tuple[Column, float]) -> Column:
    """``base`` less what each condition that holds takes off, to 2 places, from 0 to 1."""
    left = base
    for holds, loss in losses:
        left = left - F.when(holds, loss).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(left, 2)))


def redacted(trail: Column, view: str) -> Column:
    """Of array<struct<ai_suggestion, final_value, ai_confidence>>: all of it (full), none (public), or (operator) without
    confidences and with suggestions that weren't adopted masked; any other view is taken as public."""
    if view == "full":
        return trail
    if view != "operator":
        return F.filter(trail, lambda e: F.lit(False))
    adopted = lambda e: F.when(e["ai_suggestion"].eqNullSafe(e["final_value"]), e["ai_suggestion"]).otherwise("***redacted***")
    return F.transform(trail, lambda e: F.struct(adopted(e).alias("ai_suggestion"), e["final_value"].alias("final_value"), F.lit(None).cast("double").alias("ai_confidence")))

"""Outline trees of headings, bodies under known headings, and upserts by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltworks.functions.titles import section_relevance
from siltworks.operators.ordered import fresh, parts

#: Headings of cases, and characters kept of a body.
CASE_SECTIONS = ["背景", "问题", "解决方案", "效果", "反思"]
SECTION_CHARS = 384
MAX_DEPTH = 3


def outline(headings: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Headings (doc_id, seq, level) with ``depth``, ``parent`` (seq, null under the root), ``order_index`` and ``leaf``.

    A document's shallowest heading has depth 1; deeper ones than ``max_depth`` count as
    that deep.  The parent is the last heading before that is less deep, and a heading has
    children just if the next one is deeper.
    """
    by_doc = Window.partitionBy("doc_id")
    rows = headings.withColumn("depth", F.least(F.col("level") - F.min("level").over(by_doc) + 1, F.lit(max_depth)).cast("int"))
    in_order = by_doc.orderBy("seq")
    last_above = lambda d: F.last(F.when(F.col("depth") < d, F.col("seq")), ignorenulls=True).over(in_order)
    parent = F.coalesce(*[F.when(F.col("depth") == d, last_above(d)) for d in range(1, max_depth + 1)])
    rows = rows.withColumn("parent", parent).withColumn("leaf", F.coalesce(F.lead("depth").over(in_order) <= F.col("depth"), F.lit(True)))
    return rows.withColumn("order_index", F.row_number().over(Window.partitionBy("doc_id", "parent").orderBy("seq")) - 1)


def case_sections(text: Column, names: list[str] = CASE_SECTIONS, chars: int = SECTION_CHARS) -> Column:
    """array<struct<name, body>> of the bodies after each heading, cut to ``chars``; text before the first goes, as do blank bodies."""
    heading = rf"\n\s*({'|'.join(names)})\s*[:：]?\s*\n?"
    lines = F.concat(F.lit("\n"), text)
    found = F.regexp_extract_all(lines, F.lit(heading), F.lit(1))
    bodies = F.slice(F.split(lines, heading), F.lit(2), F.size(found))
    made = F.zip_with(found, bodies, lambda n, b: F.struct(n.alias("name"), F.substring(F.regexp_replace(b, r"^\s+|\s+$", ""), 1, chars).alias("body")))
    return F.filter(made, lambda s: s["body"] != "")


def upsert(held: DataFrame, new: DataFrame, keys: list[str], order: str, insert: bool = True) -> DataFrame:
    """``held`` with the rows of ``new`` put in by key; of several new ones of a key the last by ``order`` counts, of equally late ones the greatest.

    ``held`` must have each key once; without ``insert``, new rows of other keys are left out.  Both sides are dealt by key into parts
    of a bounded number of rows; many new rows of one key are combined in several tasks first.
    """
    rest = [c for c in held.columns if c not in keys]
    n = parts(held.count(), new.count())
    row, salt = fresh(held, "row", "salt")
    late = F.struct(F.col(order).alias("order_"), F.struct(*rest).alias("kept"))
    rows = new.select(*keys, late.alias(row), F.pmod(F.xxhash64(order), F.lit(16)).alias(salt))
    some = rows.repartition(n, *keys, salt).groupBy(*keys, salt).agg(F.max(row).alias(row))
    last = some.repartition(n, *keys).groupBy(*keys).agg(F.max(row).alias(row))
    joined = held.repartition(n, *keys).join(last, keys, "full" if insert else "left")
    return joined.select(*keys, *[F.when(F.col(row).isNull(), F.col(c)).otherwise(F.col(f"{row}.kept.{c}")).alias(c) for c in rest])


# Types of nodes whose place must be known.
PLACED = ["task", "task_section", "operation_step", "task_artifact", "assessment"]


def outline_quality(outlines: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Counts, ratios and ``review_required`` of each of ``outlines`` (key, blocks, assigned).

    ``nodes``: key, node_type, parent, seq, step_no, locator.  An outline without nodes has
    no located share and so needs a review; without artifacts or numbered steps, theirs are 1.
    Steps of a parent that keep their order are found with a lag, so no list is gathered.
    """
    steps = nodes.filter("node_type = 'operation_step' and step_no is not null")
    before = F.lag("step_no").over(Window.partitionBy(key, "parent").orderBy("seq"))
    ordered = steps.select(key, "parent", (F.coalesce(before, F.col("step_no")) <= F.col("step_no")).alias("fine")).groupBy(key, "parent").agg(F.bool_and("fine").alias("fine"))
    valid = ordered.groupBy(key).agg(F.round(F.avg(F.col("fine").cast("int")), 4).alias("step_order_validity"))
    kind = F.col("node_type")
    high, artifact = kind.isin(PLACED), kind == "task_artifact"
    of = {
        "project_count": kind == "project",
        "task_count": kind == "task",
        "section_count": kind == "task_section",
        "operation_step_count": kind == "operation_step",
        "artifact_count": artifact,
        "high": high,
        "located": high & F.col("locator").isNotNull(),
        "projected": high & (kind != "assessment"),
        "bound": artifact & F.col("parent").isNotNull(),
    }
    counts = nodes.groupBy(key).agg(*[F.count_if(c).alias(n) for n, c in of.items()])
    x = outlines.join(counts, key, "left").join(valid, key, "left").fillna(0, list(of)).fillna(1.0, ["step_order_validity"])
    ratio = lambda n, d, empty: F.when(d > 0, n / d).otherwise(empty)
    located, projected = ratio(F.col("located"), F.col("high"), 0.0), F.when(F.col("projected") > 0, 1.0).otherwise(0.0)
    bound, orphans = ratio(F.col("bound"), F.col("artifact_count"), 1.0), 1.0 - ratio(F.col("assigned"), F.col("blocks"), 0.0)
    return x.select(
        key,
        *list(of)[:5],
        F.when(F.col("task_count") > 0, 1.0).otherwise(0.0).alias("task_coverage"),
        F.round(F.col("section_count") / F.greatest("task_count", F.lit(1)), 4).alias("section_coverage"),
        "step_order_validity",
        F.round(bound, 4).alias("artifact_binding_rate"),
        F.round(located, 4).alias("locator_coverage"),
        projected.alias("chunk_projection_coverage"),
        F.round(F.greatest(orphans, F.lit(0.0)), 4).alias("orphan_block_ratio"),
        ((located < 0.95) | (projected < 0.9) | (bound < 0.7)).alias("review_required"),
    )


def best_sections(hits: DataFrame, top: int = 3, by_path: bool = False) -> DataFrame:
    """(query_id, section, seq, n_hits, strong, score, place): the ``top`` sections of each request, numbered by ``place`` in document order (seq).

    Hits: query_id, query, section, seq, title, score, rank, and ``weak``: for sections of an outline (by_path False) whether the hit only asks
    or sets a task; for sections of a document (by_path) whether the section's heading path is missing, and ``path``, its titles.
    Sections whose title (or path) fits the query at 0.45 or more come first, then those of the higher best score, with 0.35 of that fit, a bonus for further hits and
    a loss if all hits (or the heading) are weak; then those of the earlier first hit.  Hits are combined by section before they are ranked.
    """
    fit = section_relevance(F.col("query"), F.col("title"))
    if by_path:
        fit = F.greatest(fit, section_relevance(F.col("query"), F.col("path")))
    most, each = (3, 0.015) if by_path else (2, 0.01)
    grouped = hits.groupBy("query_id", "section").agg(
        F.min("seq").alias("seq"),
        F.count("*").alias("n_hits"),
        F.max(F.coalesce(F.col("score").cast("double"), F.lit(0.0))).alias("best"),
        F.min("rank").alias("first"),
        F.max(fit).alias("fit"),
        F.bool_and(F.coalesce("weak", F.lit(False))).alias("weak"),
    )
    score = F.col("best") + 0.35 * F.col("fit") + each * F.least(F.col("n_hits") - 1, F.lit(most)) - F.when(F.col("weak"), 0.08).otherwise(0.0)
    rows = grouped.withColumn("strong", F.col("fit") >= 0.45).withColumn("score", F.round(score, 9))  # so that equal sums tie
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("strong").desc(), F.col("score").desc(), "first"))
    kept = rows.withColumn("nth", nth).filter(F.col("nth") <= top)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("seq", "section"))
    return kept.select("query_id", "section", "seq", "n_hits", "strong", "score", place.alias("place"))

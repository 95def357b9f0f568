"""Structured plans: held against the whitelists of a profile, then run as one select."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.operators.predicates import matches

DEFAULT_LIMIT, MAX_LIMIT = 50, 200


class PlanError(ValueError):
    """What a plan asks for that its profile doesn't allow."""


@dataclass(frozen=True)
class Profile:
    """Names a plan may use.  ``columns`` maps them to columns; ``metrics`` maps "function:field" to an aggregate."""

    key: str
    columns: dict[str, str]
    metrics: dict[str, Callable[[], Column]] = field(default_factory=dict)
    filters: frozenset[str] = frozenset()
    group_by: frozenset[str] = frozenset()
    contains: frozenset[str] = frozenset()
    default_order: tuple[tuple[str, str], ...] = ()
    tag_types: frozenset[str] = frozenset()
    #: The column of rows that tags point to.
    tag_target: str | None = None


@dataclass(frozen=True)
class Plan:
    filters: dict[str, Any] = field(default_factory=dict)
    group_by: tuple[str, ...] = ()
    metrics: tuple[str, ...] = ()
    order_by: tuple[tuple[str, str], ...] = ()
    tags: dict[str, list[str]] = field(default_factory=dict)
    limit: int = DEFAULT_LIMIT
    offset: int = 0


def check(plan: Plan, profile: Profile) -> None:
    """Raise on the first thing that isn't allowed."""
    for what, asked, allowed in (
        ("filter", plan.filters, profile.filters),
        ("group key", plan.group_by, profile.group_by),
        ("metric", plan.metrics, frozenset(profile.metrics)),
        ("order field", [f for f, _ in plan.order_by], profile.filters | profile.group_by),
        ("tag type", plan.tags, profile.tag_types),
    ):
        for name in asked:
            if name not in allowed:
                raise PlanError(f"{profile.key} has no {what} {name!r}")
    if not 1 <= plan.limit <= MAX_LIMIT or plan.offset < 0:
        raise PlanError(f"limit must be 1 to {MAX_LIMIT}, offset 0 or more")


def ordered(name: str, way: str) -> Column:
    """Nulls last going up, first going down."""
    return F.col(name).desc_nulls_first() if way == "desc" else F.col(name).asc_nulls_last()


def rounded(metric: Column) -> Column:
    return F.round(F.coalesce(metric.cast("double"), F.lit(0.0)), 2)


def tagged(plan: Plan, profile: Profile, rows: DataFrame, index: DataFrame | None) -> DataFrame:
    """Rows whose target has, of each tag type that the plan names, any of the values; ``index``: (tag_type, tag_value, target_id)."""
    for kind, values in plan.tags.items():
        if index is None or profile.tag_target is None:
            raise PlanError(f"{profile.key} has no index of tags")
        chosen = index.filter((F.col("tag_type") == kind) & F.col("tag_value").isin(list(values))).select(F.col("target_id").alias("_tagged_id")).distinct()
        rows = rows.join(chosen, rows[profile.tag_target] == chosen["_tagged_id"], "left_semi")
    return rows


def run(plan: Plan, profile: Profile, rows: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Filtered rows, or groups by the first key with the first metric and the number of rows; tags are looked up in ``index``."""
    check(plan, profile)
    rows = tagged(plan, profile, rows, index)
    for name, condition in plan.filters.items():
        rows = rows.filter(matches(F.col(profile.columns[name]), condition, name in profile.contains))
    order = plan.order_by or profile.default_order
    if plan.group_by:
        key = plan.group_by[0]
        metric = profile.metrics[plan.metrics[0]]() if plan.metrics else F.count("*")
        rows = rows.groupBy(F.col(profile.columns[key]).alias(key)).agg(rounded(metric).alias("metric_value"), F.count("*").alias("record_count"))
        order = [x for x in order if x[0] == key] or [(key, "asc")]
    else:
        rows = rows.select(*[F.col(c).alias(n) for n, c in profile.columns.items()])
    return rows.orderBy(*[ordered(n, w) for n, w in order]).offset(plan.offset).limit(plan.limit)

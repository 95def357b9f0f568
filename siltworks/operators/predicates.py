"""Filter conditions as columns."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(column: Column, condition: Any, contains: bool = False) -> Column:
    """Dict: gte, lte, between (inclusive), combined; list: IN; text on a ``contains`` field: substring; else equal."""
    if isinstance(condition, dict):
        parts = []
        for way, value in condition.items():
            if way == "between":
                parts.append(column.between(*value))
            elif way == "gte":
                parts.append(column >= value)
            elif way == "lte":
                parts.append(column <= value)
            else:
                raise ValueError(f"no such operator: {way}")
        return reduce(and_, parts, F.lit(True))
    if isinstance(condition, (list, tuple, set)):
        return column.isin(*condition)
    if isinstance(condition, str) and contains:
        return column.contains(condition)
    return column == condition


def any_case_contains(column: Column, value: str) -> Column:
    """ILIKE %value%; a blank value holds for all; % and _ in it are wildcards."""
    value = value.strip()
    return column.ilike(f"%{value}%") if value else F.lit(True)


def any_column_contains(columns: Iterable[Column], terms: Iterable[str]) -> Column:
    terms = list(dict.fromkeys(terms))
    return reduce(or_, [F.coalesce(any_case_contains(c, t), F.lit(False)) for c in columns for t in terms], F.lit(False))


def named_in(text: str, names: DataFrame, column: str, limit: int = 16) -> DataFrame:
    """Distinct values that ``text`` contains, the longest first."""
    found = names.select(column).filter(F.col(column).isNotNull() & F.lit(text).contains(F.col(column))).distinct()
    return found.orderBy(F.length(column).desc(), column).limit(limit)


def year_or_all(rows: DataFrame, ts: str, year: int) -> DataFrame:
    """Rows of that year; if no row has a date at all, every row, flagged as relaxed."""
    strict = F.year(ts) == year
    dated = rows.filter(F.col(ts).isNotNull()).limit(1).count() > 0
    return rows.filter(strict).withColumn("relaxed", F.lit(False)) if dated else rows.withColumn("relaxed", F.lit(True))

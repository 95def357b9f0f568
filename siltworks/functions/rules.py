"""Decisions, gates and tag rows as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_filled(*values: Column, default: str | None = None) -> Column:
    """The first value that isn't blank, trimmed; else the default."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values], F.lit(default))


def first_reason(*reasons: tuple[str, Column]) -> Column:
    """The name of the first condition that holds; null conditions don't; null if none does."""
    chain = F.lit(None).cast("string")
    for name, condition in reversed(reasons):
        chain = F.when(condition, name).otherwise(chain)
    return chain


def all_reasons(*reasons: tuple[str, Column]) -> Column:
    """The names of all conditions that hold, in the order given."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in reasons]))


def confidence_level(value: Column, high: float, middle: float) -> Column:
    """high, mid or low; null counts as low."""
    return F.when(value >= high, "high").when(value >= middle, "mid").otherwise("low")


def tag_rows(fields: dict[str, Column]) -> Column:
    """Array of struct<tag_type, tag_value> of the fields that are filled; explode it for rows."""
    pairs = [F.when(F.trim(v.cast("string")) != "", F.struct(F.lit(k).alias("tag_type"), F.trim(v.cast("string")).alias("tag_value"))) for k, v in fields.items()]
    return F.array_compact(F.array(*pairs))


def plausible_year(value: Column) -> Column:
    """A whole number from 1900 to 2100; null if it is none."""
    year = F.trim(value.cast("string")).try_cast("int")
    return F.when(year.between(1900, 2100), year)


def to_timestamp_utc(value: Column) -> tuple[Column, Column]:
    """The ISO-8601 time in a text, and whether a text that isn't blank failed to give one."""
    text = F.nullif(F.trim(value), F.lit(""))
    made = F.try_to_timestamp(text)
    return made, text.isNotNull() & made.isNull()


def plain_literal(value: Column) -> Column:
    """Full-width percent signs made plain, and no spaces between digits."""
    return F.regexp_replace(F.translate(F.trim(value), "％", "%"), r"(?<=[0-9])\s+(?=[0-9%])", "")


def link_share(html: Column) -> Column:
    """Characters of link texts for each character of the page's text that isn't space, to 4 places; 0 for no text."""
    solid = lambda t: F.length(F.regexp_replace(F.regexp_replace(t, "<[^>]*>", ""), r"\s+", ""))
    links = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1))
    linked = F.aggregate(links, F.lit(0), lambda a, t: a + solid(t))
    return F.when(solid(html) > 0, F.round(linked / solid(html), 4)).otherwise(0.0)


def join_lines(text: Column) -> Column:
    """Lines joined by spaces; a word broken by a hyphen at a line's end is made whole."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"([A-Za-z])-\r?\n\s*([a-z])", "$1$2"), r"\s*\r?\n\s*", " "))


def weak_evidence(titles: Column, content: Column) -> Column:
    """Hits that name goals or contents and answer nothing."""
    text = F.trim(F.coalesce(content, F.lit("")))
    return F.coalesce(titles, F.lit("")).contains("学习目标") | text.startswith("目录") | text.startswith("目 录") | text.startswith("知识回顾")


def graph_gate(retained: Column, facts: Column, links: Column, single: Column, multi: Column, generic: Column, per_chunk: Column) -> tuple[Column, Column]:
    """(warnings, blockers) of a graph's figures; nulls count as 0."""
    retained, facts, links, single, multi, generic, per_chunk = (F.coalesce(c, F.lit(0)) for c in (retained, facts, links, single, multi, generic, per_chunk))
    named = lambda *pairs: F.array_compact(F.array(*[F.when(holds, name) for name, holds in pairs]))
    warnings = named(
        ("no_chunk_context_links", (retained >= 3) & (links == 0)),
        ("over_localized_single_chunk_graph", (retained >= 5) & (single > 0.9) & (per_chunk > 1.5)),
        ("generic_entity_ratio_high", (retained >= 3) & (generic > 0.3)),
        ("multi_chunk_context_low", (retained >= 5) & (multi < 0.1)),
    )
    return warnings, named(("no_persisted_graph_rows", facts == 0))

"""Nulls, blanks and ties in the decision columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.functions import rules


def only(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_reasons(spark):
    no, yes = F.lit(None).cast("boolean"), F.lit(True)
    assert only(spark, rules.first_reason(("a", no), ("b", yes), ("c", yes))) == "b"
    assert only(spark, rules.first_reason(("a", no))) is None
    assert only(spark, rules.all_reasons(("a", no), ("b", yes), ("c", yes))) == ["b", "c"]


def test_values(spark):
    text = lambda t: F.lit(t).cast("string")
    assert only(spark, rules.first_filled(text(None), text("  "), default="x")) == "x"
    assert only(spark, rules.confidence_level(F.lit(None).cast("double"), 0.8, 0.5)) == "low"
    assert [only(spark, rules.plausible_year(text(t))) for t in (" 1900", "2101", "soon", None)] == [1900, None, None, None]
    assert only(spark, rules.plain_literal(text(" 12 000 ％"))) == "12000%"
    assert only(spark, rules.join_lines(text("a hyphen-\n ated word\nends"))) == "a hyphenated word ends"
    assert only(spark, rules.link_share(text("<a href='x'>ab</a> cd"))) == 0.5
    assert only(spark, rules.link_share(text(""))) == 0.0


def test_tag_rows_and_times(spark):
    rows = only(spark, rules.tag_rows({"a": F.lit(" v "), "b": F.lit(""), "c": F.lit(None).cast("string"), "d": F.lit(3)}))
    assert [tuple(r) for r in rows] == [("a", "v"), ("d", "3")]
    for t, failed in (("soon", True), (" ", False), (None, False), ("2024-01-02T03:04:05Z", False)):
        assert only(spark, rules.to_timestamp_utc(F.lit(t).cast("string"))[1]) is failed

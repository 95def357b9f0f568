"""Defined cases of fact governance, decisions and outline quality: nulls, blanks, empty tables, full chunks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siltworks.functions import screens
from siltworks.operators import governance as g
from siltworks.operators import sections

FACT = "seq int, fact_type string, predicate string, subject string, object string, object_literal string, source_chunk string, evidence array<string>, context_for array<string>, context_role string, confidence double"
CORE = ("definition_fact", "defines", "a", "b", None)


def test_full_chunks_keep_facts_of_several_chunks(spark):
    rows = [(i, *CORE, "c", ["c", "d"] if i == 9 else None, None, None, 0.7) for i in range(10)] + [(10, *CORE, "e", None, None, None, 0.7)]
    got = {r["seq"]: r["rejected"] for r in g.govern(spark.createDataFrame(rows, FACT), "seq").collect()}
    assert [i for i, why in got.items() if why] == [8] and got[8] == "per_chunk_overrun"


def test_facts_of_nulls_and_no_facts(spark):
    empty = spark.createDataFrame([], FACT)
    assert g.govern(empty, "seq").count() == 0
    row = g.govern(spark.createDataFrame([(None,) * 11], FACT), "seq").first()
    assert (row["role"], row["rejected"], row["salience"]) == ("supporting_evidence", "low_salience", 0.124)
    with pytest.raises(ValueError):
        g.govern(empty, "seq", most=0)


def test_decisions_of_nulls(spark):
    one = spark.range(1).select(
        g.decision("classification", F.lit(None).cast("string"), F.lit(0.9), 0.6, ["L1"]).alias("unknown"),
        g.decision("tags", F.lit(None).cast("string"), F.lit(None).cast("double"), 0.6).alias("unsure"),
        g.admitted(F.lit("available"), F.lit(True), F.lit("pass"), F.lit(None).cast("array<string>")).alias("no_trail"),
        g.admitted(F.lit("available"), F.lit(True), F.lit("pass"), F.array(F.lit(None).cast("string"))).alias("open"),
        g.section_key(F.lit("r"), F.array().cast("array<struct<level:int,title:string>>"), F.lit(""), F.lit(None).cast("array<string>")).alias("key"),
        screens.noise_reason(F.lit("image"), F.lit(None).cast("string")).alias("noise"),
    ).first()
    assert one["unknown"]["reason"] == "classification '' not in valid set" and one["unsure"]["status"] == "review_required"
    assert one["no_trail"] and not one["open"] and one["key"] is None and one["noise"] is None


def test_subjects_without_entities(spark):
    none = g.subject(spark.createDataFrame([], "kind string, name string"), "who").collect()
    assert [tuple(r) for r in none] == [("unknown", None)]
    short = spark.createDataFrame([("job", "w"), ("job", None), ("major", " 。"), ("job", "Who")], "kind string, name string")
    assert tuple(g.subject(short, "w h o?").first()) == ("job", "Who")


def test_outlines_without_nodes_need_a_review(spark):
    nodes = spark.createDataFrame([], "k long, node_type string, parent long, seq int, step_no int, locator string")
    row = sections.outline_quality(spark.createDataFrame([(1, 0, 0)], "k long, blocks long, assigned long"), nodes, "k").first()
    assert row["review_required"] and row["step_order_validity"] == 1.0 and row["orphan_block_ratio"] == 1.0 and row["task_count"] == 0

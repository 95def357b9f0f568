"""Parts of shuffles that a task sorts or groups: their number follows the rows, whatever Spark would put together."""

from __future__ import annotations

import re

from siltworks.operators import abilities, ordered, sections
from siltworks.queries import payloads


def stated(df) -> list[int]:
    """Parts of the shuffles that are dealt by number."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [int(n) for n in re.findall(r"hashpartitioning\([^\n]*, (\d+)\), REPARTITION_BY_NUM", plan)]


def test_upsert_is_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(ordered, "TASK_ROWS", 50)
    held = spark.range(300).selectExpr("id AS k", "id * 1.0D AS price").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k, 5.0D AS price"))
    new = spark.range(400).selectExpr("id * 3 AS k", "CAST(id AS INT) AS at", "-1.0D AS price").unionByName(spark.sql("SELECT 0L AS k, 7 AS at, CAST(NULL AS DOUBLE) AS price UNION ALL SELECT 1L, NULL, 2.0D UNION ALL SELECT 1L, 1, 1.0D"))
    whole = sections.upsert(held, new, ["k"], "at")
    assert min(stated(whole)) == -(-(301 + 403) // 50)
    want = {None: 5.0} | {k: float(k) for k in range(300)} | {3 * k: -1.0 for k in range(400)} | {0: None, 1: 1.0}
    rows = whole.collect()
    assert len(rows) == len(want) and {r.k: r.price for r in rows} == want
    rows = sections.upsert(held, new, ["k"], "at", insert=False).collect()
    assert {r.k: r.price for r in rows} == {k: v for k, v in want.items() if k is None or k < 300} and len(rows) == 301


def test_findings_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(ordered, "TASK_ROWS", 50)
    analyses = spark.range(200).selectExpr("id AS analysis", "'M' AS profile", "'M' AS model", "true AS declared", "true AS linked")
    items = spark.range(600).selectExpr("id % 200 AS analysis", "id AS ability", "concat('P-1.', id % 200, '.', id) AS code", "'P' AS category", "'content' AS content", "id AS task", "id AS work_content")
    codes = spark.range(200).selectExpr("id AS analysis", "CASE WHEN id % 50 = 7 THEN '2.1' ELSE concat('1.', id) END AS code")
    specs = spark.createDataFrame([("M", "P", True, r"P-.*", True, 3), ("M", "G", False, "G", False, 2)], "profile string, category string, required boolean, regex string, needs_content boolean, segments int")
    overview = codes.filter("analysis < 150").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS analysis, 'x' AS code"))
    found = abilities.findings(analyses, specs, items, codes.unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS analysis, 'x' AS code")), overview)
    dealt = stated(found)
    assert len(dealt) >= 6 and set(dealt) == {16}
    assert {(r.analysis, r.rule) for r in found.collect()} == {(a, abilities.RULES["sets"]) for a in (None, 7, 57, 107)}


def test_redaction_is_dealt_by_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(payloads, "REDACTED_ROWS", 30)
    spark.range(100).selectExpr("id AS event_id", "id AS user_id", "'click' AS event_type", """'{"a": 1}' AS props""").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = payloads.r9_22_redacted_props(spark, str(tmp_path))
    assert set(stated(found)) == {4} and found.count() == 100

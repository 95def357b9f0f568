"""Fact governance, decision trails, admission, routing and keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.operators import governance as g
from siltworks.registry import query
from siltworks.sources.readers import table


def listed(values: list[str]) -> str:
    return ", ".join(f"'{x}'" for x in values)


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as facts of their supplier's chunk."""
    kinds = F.array(*[F.lit(x) for x in ("definition_fact", "entity_mention", "other", "metric_fact", "example_fact", "trend_fact", "step_fact")])
    does = F.array(*[F.lit(x) for x in (" defines", "mentions", "SAYS", "has_value", "提到")])
    x = table(spark, d, "lineitem").withColumn("fact_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return x.select(
        "fact_id",
        F.get(kinds, (F.col("l_linenumber") % 7).cast("int")).alias("fact_type"),
        F.get(does, (F.col("l_partkey") % 5).cast("int")).alias("predicate"),
        F.when(F.col("l_partkey") % 9 == 0, " 内容").otherwise("a").alias("subject"),
        F.when(F.col("l_tax") > 0.03, "b").alias("object"),
        F.when(F.col("l_orderkey") % 2 == 0, F.expr("repeat('x', l_linenumber * 20)")).alias("object_literal"),
        F.col("l_suppkey").cast("string").alias("source_chunk"),
        F.when(F.col("l_quantity") > 40, F.array(F.col("l_suppkey").cast("string"), F.lit("z"))).alias("evidence"),
        F.when(F.col("l_quantity") < 5, F.array(F.lit("p"), F.lit("q"), F.lit("p"))).alias("context_for"),
        F.when(F.col("l_returnflag") == "R", "trend").when(F.col("l_returnflag") == "A", "none").alias("context_role"),
        (F.col("l_discount") * 10).alias("confidence"),
    )


FACTS = f"""f AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS fact_id,
  ['definition_fact', 'entity_mention', 'other', 'metric_fact', 'example_fact', 'trend_fact', 'step_fact'][l_linenumber % 7 + 1] AS kind,
  ['DEFINES', 'MENTIONS', 'SAYS', 'HAS_VALUE', '提到'][l_partkey % 5 + 1] AS does, l_partkey % 9 = 0 AS generic,
  l_tax > 0.03 AS obj, CASE WHEN l_orderkey % 2 = 0 THEN l_linenumber * 20 ELSE 0 END AS lit, l_suppkey::VARCHAR AS chunk,
  l_quantity > 40 AS many, l_quantity < 5 AS helps, l_returnflag = 'R' AS named, least(1.0, l_discount * 10) AS conf FROM lineitem),
s AS (SELECT *, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.25::DOUBLE + CASE WHEN kind IN ({listed(g.CORE_TYPES)}) THEN 0.24 ELSE 0 END - CASE WHEN kind IN ({listed(g.LOW_TYPES)}) THEN 0.18 ELSE 0 END
  + CASE WHEN does IN ('DEFINES', 'HAS_VALUE') THEN 0.18 ELSE 0 END - CASE WHEN does IN ('MENTIONS', '提到') THEN 0.16 ELSE 0 END + CASE WHEN obj THEN 0.08 ELSE 0 END
  + least(0.16::DOUBLE, lit / 500.0::DOUBLE) + CASE WHEN many THEN 0.18 ELSE 0 END + CASE WHEN helps THEN 0.12 ELSE 0 END + CASE WHEN named THEN 0.08 ELSE 0 END
  + (conf - 0.7) * 0.18 - CASE WHEN generic THEN 0.18 ELSE 0 END)), 4) AS salience FROM f)"""


@query(f"WITH {FACTS} SELECT fact_id, salience FROM s")
def r9_28_salience(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).select("fact_id", g.salience().alias("salience"))


@query(f"""WITH {FACTS}, r AS (SELECT *, CASE WHEN named THEN 'trend' WHEN kind = 'definition_fact' OR does = 'DEFINES' THEN 'definition' WHEN kind = 'metric_fact' OR does = 'HAS_VALUE' THEN 'metric_context'
  WHEN kind = 'trend_fact' THEN 'trend' WHEN kind = 'step_fact' THEN 'procedure' ELSE 'supporting_evidence' END AS role FROM s),
w AS (SELECT *, CASE WHEN generic AND salience < 0.75 THEN 'generic_entity' WHEN kind IN ({listed(g.LOW_TYPES)}) AND does IN ('MENTIONS', '提到') AND NOT many AND role = 'supporting_evidence' THEN 'weak_local_mention' WHEN salience < 0.45 THEN 'low_salience' END AS why FROM r),
c AS (SELECT *, count(*) FILTER (why IS NULL) OVER (PARTITION BY chunk ORDER BY fact_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS had FROM w)
SELECT fact_id, role, round(least(1.0::DOUBLE, salience + CASE WHEN many OR helps THEN 0.08 ELSE 0 END + CASE WHEN many THEN 0.06 ELSE 0 END), 4) AS priority,
  coalesce(why, CASE WHEN had >= 8 AND NOT many THEN 'per_chunk_overrun' END) AS rejected FROM c""")
def r11_11_governed_facts(spark: SparkSession, d: str) -> DataFrame:
    return g.govern(facts(spark, d), "fact_id").select("fact_id", "role", "priority", "rejected")


SURE = "(o_orderkey % 100) / 100.0"


@query(f"""SELECT o_orderkey, CASE WHEN {SURE} < 0.6 THEN 'confidence ' || printf('%.2f', ({SURE})::DOUBLE) || ' < threshold 0.6' WHEN o_orderstatus NOT IN ('O', 'P') THEN 'classification ''' || o_orderstatus || ''' not in valid set' END AS reason,
CASE WHEN {SURE} < 0.6 OR o_orderstatus NOT IN ('O', 'P') THEN 'review_required' ELSE 'auto_adopted' END AS status FROM orders""")
def r12_01_classification_decision(spark: SparkSession, d: str) -> DataFrame:
    made = g.decision("classification", F.col("o_orderstatus"), F.expr(SURE), 0.6, ["O", "P"])
    return table(spark, d, "orders").select("o_orderkey", made.alias("m")).select("o_orderkey", "m.reason", "m.status")


@query(f"""SELECT o_orderkey, o_orderpriority || ',x' AS tags, CASE WHEN {SURE} < 0.8 THEN 'confidence ' || printf('%.2f', ({SURE})::DOUBLE) || ' < threshold 0.8' END AS reason, CASE WHEN {SURE} < 0.8 THEN 'review_required' ELSE 'auto_adopted' END AS status FROM orders""")
def r12_02_tag_decision(spark: SparkSession, d: str) -> DataFrame:
    made = g.decision("tags", F.array("o_orderpriority", F.lit("x")), F.expr(SURE), 0.8)
    return table(spark, d, "orders").select("o_orderkey", made.alias("m")).select("o_orderkey", F.array_join("m.value", ",").alias("tags"), "m.reason", "m.status")


@query("""SELECT o_orderkey, o_orderstatus = 'F' AND o_orderkey % 3 > 0 AND o_totalprice > 1000 AND coalesce(bool_and(l_returnflag <> 'N' OR l_returnflag IS NULL), true) AS admitted FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus, o_totalprice""")
def r12_05_whole_admission(spark: SparkSession, d: str) -> DataFrame:
    """Status, admission, level, and each decision of the trail."""
    trail = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_returnflag") == "N", "review_required").when(F.col("l_returnflag") == "R", "human_confirmed").otherwise("auto_adopted")).alias("trail"))
    x = table(spark, d, "orders").join(trail, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    status = F.when(F.col("o_orderstatus") == "F", "available").otherwise("review_required")
    level = F.when(F.col("o_totalprice") > 1000, "pass").otherwise("warn")
    return x.select("o_orderkey", g.admitted(status, F.col("o_orderkey") % 3 > 0, level, F.col("trail")).alias("admitted"))


CO_TEXTS = ["常见 Q&A", "岗位与能力要求", "操作流程", "KPI", "场景", "技能点", "职业能力", "plain", None]


@query("""SELECT event_id, ([0.7, 0.3, 0.3, 0.3, 0.3, 0.3, 0.3, 0.3, 0.3]::DOUBLE[])[event_id % 9 + 1] AS qa, ([0.3, 0.75, 0.3, 0.3, 0.3, 0.3, 0.3, 0.3, 0.3]::DOUBLE[])[event_id % 9 + 1] AS relations,
([0.3, 0.3, 0.7, 0.3, 0.3, 0.3, 0.3, 0.3, 0.3]::DOUBLE[])[event_id % 9 + 1] AS steps, ([0.3, 0.3, 0.3, 0.7, 0.3, 0.3, 0.3, 0.3, 0.3]::DOUBLE[])[event_id % 9 + 1] AS indicators,
([0.3, 0.3, 0.3, 0.3, 0.7, 0.3, 0.3, 0.3, 0.3]::DOUBLE[])[event_id % 9 + 1] AS cases, ([0.3, 0.3, 0.3, 0.3, 0.3, 0.75, 0.3, 0.3, 0.3]::DOUBLE[])[event_id % 9 + 1] AS skills,
([0.3, 0.3, 0.3, 0.3, 0.3, 0.3, 0.75, 0.3, 0.3]::DOUBLE[])[event_id % 9 + 1] AS competency, 0.0::DOUBLE AS other FROM events""")
def r12_10_co_emissions(spark: SparkSession, d: str) -> DataFrame:
    cell = F.get(F.array(*[F.lit(x) for x in CO_TEXTS]), (F.col("event_id") % len(CO_TEXTS)).cast("int"))
    names = ("qa", "relations", "steps", "indicators", "cases", "skills", "competency", "other")
    made = [g.co_emission(c, cell, F.lit(None).cast("string")).alias(n) for n, c in zip(names, [*g.CO_EMISSIONS, "unknown"], strict=True)]
    return table(spark, d, "events").select("event_id", *made)


QUESTIONS = ["A Cold Widget, for FURNITURE?", "cold widget for automobile", "what of furniture", "neither"]


@query(f"""WITH q(question) AS (VALUES {", ".join(f"('{x}')" for x in QUESTIONS)}), e AS (SELECT DISTINCT 'job' AS kind, p_name AS name FROM part UNION SELECT 'major', c_mktsegment FROM customer),
k AS (SELECT question, kind, name, length(replace(name, ' ', '')) AS n FROM q JOIN e ON contains(lower(regexp_replace(question, '[ ,]', '', 'g')), lower(replace(name, ' ', '')))),
b AS (SELECT question, kind, max(n) AS n, arg_min(name, (-n, name)) AS name FROM k GROUP BY ALL)
SELECT question, CASE WHEN count(b.n) = 0 THEN 'unknown' WHEN count(b.n) = 2 AND min(b.n) = max(b.n) THEN 'ambiguous' ELSE arg_max(kind, b.n) END AS kind,
  CASE WHEN count(b.n) = 2 AND min(b.n) = max(b.n) THEN NULL ELSE arg_max(name, b.n) END AS name FROM q LEFT JOIN b USING (question) GROUP BY question""")
def r14_06_subjects(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "part").select(F.lit("job").alias("kind"), F.col("p_name").alias("name"))
    known = jobs.unionByName(table(spark, d, "customer").select(F.lit("major").alias("kind"), F.col("c_mktsegment").alias("name")))
    return reduce(DataFrame.unionByName, [g.subject(known, q).select(F.lit(q).alias("question"), "kind", "name") for q in QUESTIONS])


ROUTES = [("crawler", "Text/HTML"), ("crawler", "image/png"), ("database", None), ("webhook", "text/html"), ("nas", "application/json"), ("nas", "text/csv"), ("file_upload", "application/vnd.ms-excel"), ("file_upload", "application/pdf"), (None, None)]


@query("""SELECT event_id, (['document', 'record', 'record', 'record', 'record', 'document', 'document', 'document', 'document'])[event_id % 9 + 1] AS plain, (['document', 'record', 'record', 'record', 'record', 'record', 'record', 'document', 'document'])[event_id % 9 + 1] AS flagged FROM events""")
def r15_04_routes(spark: SparkSession, d: str) -> DataFrame:
    cases = F.array(*[F.struct(F.lit(s).cast("string").alias("s"), F.lit(m).cast("string").alias("m")) for s, m in ROUTES])
    x = table(spark, d, "events").select("event_id", F.get(cases, (F.col("event_id") % len(ROUTES)).cast("int")).alias("x"))
    return x.select("event_id", g.route(F.col("x.s"), F.col("x.m")).alias("plain"), g.route(F.col("x.s"), F.col("x.m"), sheets=True, csv=True).alias("flagged"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN left(sha256('{"heading_path":[{"level":1,"title":' || coalesce(to_json(source)::VARCHAR, 'null') || '}],"normalized_ref_id":"' || doc_id || '","section_id":null,"source_block_ids":["b' || doc_id || '"]}'), 24) END AS key FROM documents""")
def r9_34_section_keys(spark: SparkSession, d: str) -> DataFrame:
    some = F.col("doc_id") % 5 > 0
    path = F.when(some, F.array(F.struct(F.lit(1).alias("level"), F.col("source").alias("title"))))
    blocks = F.when(some, F.array(F.concat(F.lit("b"), F.col("doc_id").cast("string"))))
    return table(spark, d, "documents").select("doc_id", g.section_key(F.col("doc_id").cast("string"), path, F.lit(None).cast("string"), blocks).alias("key"))


@query("""WITH x AS (SELECT p_partkey, p_size % 5 / 5.0 AS a, p_partkey % 7 / 7.0 AS b, p_partkey % 5 / 5.0 AS c FROM part), y AS (SELECT *, CASE WHEN a >= b AND a >= c THEN 'ability' WHEN b >= c THEN 'distribution' ELSE 'demand' END AS name FROM x)
SELECT p_partkey, CASE WHEN greatest(a, b, c) <= 0 THEN 'generic_table_dataset' WHEN greatest(a, b, c) < 0.7 THEN name || '_candidate' ELSE name END AS profile FROM y""")
def r10_33_detected_profiles(spark: SparkSession, d: str) -> DataFrame:
    sure = {"ability": F.col("p_size") % 5 / 5.0, "distribution": F.col("p_partkey") % 7 / 7.0, "demand": F.col("p_partkey") % 5 / 5.0}
    return table(spark, d, "part").select("p_partkey", g.profile(sure, 0.7).alias("profile"))

"""The ten rules of abilities over orders as analyses and their lines as abilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.operators import abilities
from siltworks.operators.ordered import parts
from siltworks.registry import query
from siltworks.sources.readers import table

_ABILITY = {
    "ability": "l_orderkey * 10 + l_linenumber",
    "category": "CASE WHEN l_quantity < 2 THEN ' ' WHEN l_quantity < 4 THEN NULL ELSE CASE l_returnflag WHEN 'A' THEN 'P' WHEN 'R' THEN 'G' ELSE 'S' END END",
    "code": "CASE l_returnflag WHEN 'A' THEN 'P-' || (l_suppkey % 3) || '.' || (l_linenumber % 2) || CASE WHEN l_discount > 0.08 THEN '' ELSE '.' || (l_partkey % 4) END WHEN 'R' THEN CASE WHEN l_tax > 0.06 THEN 'X' ELSE 'G' END || '-' || (l_partkey % 3) ELSE '' END",
    "content": "CASE WHEN l_partkey % 11 = 0 THEN '无' WHEN l_partkey % 11 = 1 THEN '123' WHEN l_partkey % 11 = 2 THEN ' ab ' WHEN l_partkey % 11 = 3 THEN NULL ELSE 'content ' || l_partkey END",
    "task": "CASE WHEN l_discount > 0.01 THEN l_suppkey END",
    "work_content": "CASE WHEN l_tax > 0.01 THEN l_partkey END",
}
_HEAD = {"model": "CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderpriority = '1-URGENT' THEN 'other' ELSE 'PGSD' END", "declared": "o_orderstatus <> 'O'", "linked": "o_totalprice > 100000"}
_SPECS = [("PGSD", "P", True, r"P-[0-9]+\.[0-9]+\.[0-9]+", True, 3), ("PGSD", "G", True, "G-[0-9]+", False, 2), ("PGSD", "S", False, None, False, 2)]
_select = lambda columns: ", ".join(f"{v} AS {k}" for k, v in columns.items())
_bad = ", ".join(f"'{x}'" for x in abilities.NOTHING)


@query(rf"""WITH a AS (SELECT o_orderkey AS analysis, 'PGSD' AS profile, {_select(_HEAD)} FROM orders), i AS (SELECT l_orderkey AS analysis, l_suppkey, l_linenumber, {_select(_ABILITY)} FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
o AS (SELECT DISTINCT analysis, (l_suppkey % 3) || '.' || (l_linenumber % 2) AS code FROM i WHERE category = 'P' AND analysis % 3 = 0 UNION SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 5 = 0),
c AS (SELECT DISTINCT analysis, (l_suppkey % 3) || '.' || (l_linenumber % 2) AS code FROM i WHERE category = 'P'), m AS (SELECT DISTINCT analysis, split_part(substr(code, 3), '.', 1) || '.' || split_part(substr(code, 3), '.', 2) AS code FROM i WHERE category = 'P'),
s AS (SELECT DISTINCT x.analysis FROM (SELECT analysis, code FROM o WHERE code IS NOT NULL UNION SELECT * FROM c UNION SELECT * FROM m) x WHERE x.analysis IN (SELECT analysis FROM o)
  AND NOT ((x.analysis, x.code) IN (SELECT analysis, code FROM o WHERE code IS NOT NULL) AND (x.analysis, x.code) IN (SELECT * FROM c) AND (x.analysis, x.code) IN (SELECT * FROM m))),
f AS (SELECT analysis, 'analysis' AS kind, NULL::VARCHAR AS subject, 'model' AS r FROM a WHERE coalesce(model, '') <> profile
  UNION ALL SELECT analysis, 'analysis', NULL, 'categories' FROM a WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.analysis = a.analysis AND category = 'P') OR NOT EXISTS (SELECT 1 FROM i WHERE i.analysis = a.analysis AND category = 'G')
  UNION ALL SELECT analysis, 'analysis', NULL, 'sets' FROM s UNION ALL SELECT analysis, 'analysis', code, 'copies' FROM i WHERE code <> '' GROUP BY analysis, code HAVING count(*) > 1
  UNION ALL SELECT analysis, 'analysis', NULL, 'evidence' FROM a WHERE declared AND NOT linked UNION ALL SELECT analysis, 'ability_item', ability::VARCHAR, 'category' FROM i WHERE trim(coalesce(category, '')) = ''
  UNION ALL SELECT analysis, 'ability_item', ability::VARCHAR, 'pattern' FROM i WHERE (category = 'P' AND NOT regexp_full_match(code, 'P-[0-9]+\.[0-9]+\.[0-9]+')) OR (category = 'G' AND NOT regexp_full_match(code, 'G-[0-9]+'))
  UNION ALL SELECT analysis, 'ability_item', ability::VARCHAR, 'task' FROM i WHERE task IS NULL UNION ALL SELECT analysis, 'ability_item', ability::VARCHAR, 'content_link' FROM i WHERE task IS NOT NULL AND category = 'P' AND work_content IS NULL
  UNION ALL SELECT analysis, 'ability_item', ability::VARCHAR, 'orphan' FROM i WHERE task IS NULL AND trim(coalesce(category, '')) = ''
  UNION ALL SELECT analysis, 'ability_item', ability::VARCHAR, 'quality' FROM i WHERE trim(coalesce(content, '')) IN ({_bad}) OR regexp_full_match(trim(coalesce(content, '')), '[0-9]+') OR length(trim(coalesce(content, ''))) < 4)
SELECT analysis, kind, subject, CASE r {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in abilities.RULES.items())} END AS rule, CASE WHEN r IN ('{"', '".join(abilities.WARNINGS)}') THEN 'warning' ELSE 'blocking' END AS severity FROM f""")
def r12_07_ability_findings(spark: SparkSession, d: str) -> DataFrame:
    exprs = lambda columns: [F.expr(v).alias(k) for k, v in columns.items()]
    orders = table(spark, d, "orders")
    analyses = orders.select(F.col("o_orderkey").alias("analysis"), F.lit("PGSD").alias("profile"), *exprs(_HEAD))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("analysis"), F.concat_ws(".", (F.col("l_suppkey") % 3).cast("string"), (F.col("l_linenumber") % 2).cast("string")).alias("held"), *exprs(_ABILITY))
    held = lines.filter("category = 'P'").select("analysis", F.col("held").alias("code"))
    nothing = orders.filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("analysis"), F.lit(None).cast("string").alias("code"))
    n = parts(orders.count(), lines.count())
    overview = held.filter("analysis % 3 = 0").unionByName(nothing).repartition(n, "analysis").join(analyses.select("analysis").repartition(n, "analysis"), "analysis", "left_semi")
    specs = spark.createDataFrame(_SPECS, "profile string, category string, required boolean, regex string, needs_content boolean, segments int")
    return abilities.findings(analyses, specs, lines.drop("held"), held, overview)

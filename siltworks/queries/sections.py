"""Outline trees, case sections and keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions import screens
from siltworks.operators import sections
from siltworks.registry import query
from siltworks.sources.readers import table


@query("""WITH n AS (SELECT l_orderkey AS o_orderkey, l_extendedprice AS price FROM lineitem WHERE l_returnflag = 'R' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_extendedprice DESC) = 1)
SELECT o.o_orderkey, coalesce(n.price, o_totalprice) AS price FROM orders o LEFT JOIN n USING (o_orderkey)""")
def r1_15_keyed_upsert(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    new = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("price"), "l_linenumber")
    return sections.upsert(held, new, ["o_orderkey"], "l_linenumber", insert=False)


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents),
h AS (SELECT doc_id, seq, least(3, length(line) % 5 - min(length(line) % 5) OVER (PARTITION BY doc_id) + 1) AS depth FROM l),
p AS (SELECT *, (SELECT max(x.seq) FROM h x WHERE x.doc_id = h.doc_id AND x.seq < h.seq AND x.depth < h.depth) AS parent FROM h)
SELECT doc_id, seq, depth::INT AS depth, parent, (row_number() OVER (PARTITION BY doc_id, parent ORDER BY seq) - 1)::INT AS order_index,
  NOT EXISTS (SELECT 1 FROM p c WHERE c.doc_id = p.doc_id AND c.parent = p.seq) AS leaf FROM p""")
def r10_30_outline_tree(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    headings = lines.select("doc_id", F.col("p").cast("long").alias("seq"), (F.length("line") % 5).alias("level"))
    return sections.outline(headings).select("doc_id", "seq", "depth", "parent", "order_index", "leaf")


_names = "|".join(sections.CASE_SECTIONS)


@query(rf"""WITH t AS (SELECT doc_id, chr(10) || source || chr(10) || '背景：' || source || chr(10) || ' 问题 ' || chr(10) || text || chr(10) || '效果' || chr(10) || '反思:' || text AS text FROM documents),
s AS (SELECT doc_id, regexp_extract_all(text, '\n\s*({_names})\s*[:：]?\s*\n?', 1) AS names, string_split_regex(text, '\n\s*({_names})\s*[:：]?\s*\n?') AS parts FROM t),
e AS (SELECT doc_id, unnest(names) AS name, unnest(parts[2:]) AS part FROM s), b AS (SELECT doc_id, name, left(regexp_replace(part, '^\s+|\s+$', '', 'g'), 384) AS body FROM e)
SELECT doc_id, name, sha256(body) AS body FROM b WHERE body <> ''""")
def r10_24_case_sections(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("source", F.lit("\n背景："), "source", F.lit("\n 问题 \n"), "text", F.lit("\n效果\n反思:"), "text")
    cases = table(spark, d, "documents").select("doc_id", F.inline(sections.case_sections(text)))
    return cases.select("doc_id", "name", F.sha2("body", 256).alias("body"))


NODE_TYPES = ["project", "task", "task_section", "operation_step", "task_artifact", "assessment", "other"]


@query("""WITH n AS (SELECT l_suppkey AS k, (['project', 'task', 'task_section', 'operation_step', 'task_artifact', 'assessment', 'other'])[l_linenumber % 7 + 1] AS t, CASE WHEN l_tax > 0.02 THEN l_partkey % 20 END AS parent,
  concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS seq, CASE WHEN l_quantity > 3 THEN floor(l_quantity / 25) END AS step, l_discount > 0 OR l_suppkey % 3 = 0 AS placed FROM lineitem WHERE l_suppkey % 7 > 0),
h AS (SELECT *, t NOT IN ('project', 'other') AS high FROM n),
c AS (SELECT k, count_if(t = 'project') AS project_count, count_if(t = 'task') AS task_count, count_if(t = 'task_section') AS section_count, count_if(t = 'operation_step') AS operation_step_count, count_if(t = 'task_artifact') AS artifact_count,
  count_if(high) AS high, count_if(high AND placed) AS located, count_if(t = 'task_artifact' AND parent IS NOT NULL) AS bound, count_if(high AND t <> 'assessment') AS projected FROM h GROUP BY k),
l AS (SELECT k, parent, list(step ORDER BY seq) AS steps FROM n WHERE t = 'operation_step' AND step IS NOT NULL GROUP BY ALL),
v AS (SELECT k, round(avg((steps = list_sort(steps))::INT), 4) AS step_order_validity FROM l GROUP BY k),
x AS (SELECT s_suppkey, s_suppkey % 50 AS blocks, s_suppkey % 30 AS assigned, coalesce(step_order_validity, 1.0) AS step_order_validity, COLUMNS(c.* EXCLUDE k) FROM supplier LEFT JOIN c ON c.k = s_suppkey LEFT JOIN v ON v.k = s_suppkey),
y AS (SELECT *, CASE WHEN high > 0 THEN located / high ELSE 0.0 END AS lo, CASE WHEN artifact_count > 0 THEN bound / artifact_count ELSE 1.0 END AS bo, CASE WHEN projected > 0 THEN 1.0 ELSE 0.0 END AS pr FROM x)
SELECT s_suppkey, coalesce(project_count, 0) AS project_count, coalesce(task_count, 0) AS task_count, coalesce(section_count, 0) AS section_count, coalesce(operation_step_count, 0) AS operation_step_count, coalesce(artifact_count, 0) AS artifact_count,
  CASE WHEN task_count > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS task_coverage, round(coalesce(section_count, 0) / greatest(coalesce(task_count, 0), 1), 4)::DOUBLE AS section_coverage, step_order_validity::DOUBLE AS step_order_validity,
  round(bo, 4)::DOUBLE AS artifact_binding_rate, round(lo, 4)::DOUBLE AS locator_coverage, pr::DOUBLE AS chunk_projection_coverage, round(greatest(1 - CASE WHEN blocks > 0 THEN assigned / blocks ELSE 0 END, 0), 4)::DOUBLE AS orphan_block_ratio,
  lo < 0.95 OR pr < 0.9 OR bo < 0.7 AS review_required FROM y""")
def r15_09_whole_outline_quality(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in NODE_TYPES])
    nodes = table(spark, d, "lineitem").filter("l_suppkey % 7 > 0").select(
        F.col("l_suppkey").alias("s_suppkey"),
        F.get(kinds, (F.col("l_linenumber") % 7).cast("int")).alias("node_type"),
        F.when(F.col("l_tax") > 0.02, F.col("l_partkey") % 20).alias("parent"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("seq"),
        F.when(F.col("l_quantity") > 3, F.floor(F.col("l_quantity") / 25)).alias("step_no"),
        F.when((F.col("l_discount") > 0) | (F.col("l_suppkey") % 3 == 0), "here").alias("locator"),
    )
    outlines = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 50).alias("blocks"), (F.col("s_suppkey") % 30).alias("assigned"))
    return sections.outline_quality(outlines, nodes, "s_suppkey")


PICTURES = [("登录界面", "密码"), ("登录界面", "- a\n- b\n• c"), ("登录界面", "密码 保存"), ("流程图", "密码 保存 取消 确定 点击"), (None, "密码 保存 取消 确定 点击"), ("图", "<label>x<LABEL>"), (None, None), ("图", "- 密码")]


@query("SELECT event_id, ([true, true, true, false, true, true, false, false])[event_id % 8 + 1] AS screen FROM events")
def r11_09_screenshots(spark: SparkSession, d: str) -> DataFrame:
    cases = F.array(*[F.struct(F.lit(a).cast("string").alias("a"), F.lit(b).cast("string").alias("b")) for a, b in PICTURES])
    x = table(spark, d, "events").select("event_id", F.get(cases, (F.col("event_id") % len(PICTURES)).cast("int")).alias("x"))
    return x.select("event_id", screens.is_screenshot(F.col("x.a"), F.col("x.b")).alias("screen"))


BLOCKS = [("text", "请扫码关注我们"), ("image", "a\n > This figure is a Logo"), ("text", "> This figure is a logo"), ("chart", "> The image is a QR code."), ("text", "共 12000+份行业研究报告"), ("text", "x\n 关注公众号 \ny"), ("text", "请关注公众号"), ("image", "> The logotype"), (None, None)]


@query("SELECT event_id, (['watermark_text', 'decorative_image_vlm', NULL, 'decorative_image_vlm', 'watermark_text', 'watermark_text', NULL, NULL, NULL])[event_id % 9 + 1] AS reason FROM events")
def r10_04_noise_blocks(spark: SparkSession, d: str) -> DataFrame:
    cases = F.array(*[F.struct(F.lit(a).cast("string").alias("a"), F.lit(b).cast("string").alias("b")) for a, b in BLOCKS])
    x = table(spark, d, "events").select("event_id", F.get(cases, (F.col("event_id") % len(BLOCKS)).cast("int")).alias("x"))
    return x.select("event_id", screens.noise_reason(F.col("x.a"), F.col("x.b")).alias("reason"))


NAMES = ["我国", " 第三章  概论 （上）", "项目 二 调研", "任务3　拍摄", "ＡＢ％：x", None, "第三章概论", "国内"]


@query("SELECT event_id, (['中国', '第三章概论 (上)', '项目二调研', '任务3拍摄', 'ＡＢ%:x', NULL, '第三章概论', '中国'])[event_id % 8 + 1] AS name FROM events")
def r9_31_entity_names(spark: SparkSession, d: str) -> DataFrame:
    cell = F.get(F.array(*[F.lit(x).cast("string") for x in NAMES]), (F.col("event_id") % len(NAMES)).cast("int"))
    return table(spark, d, "events").select("event_id", screens.entity_name(cell).alias("name"))

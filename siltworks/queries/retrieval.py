"""Profiles, tags, budgets, outlines and folded names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltworks.functions import clean, fold, titles
from siltworks.functions.rules import graph_gate, weak_evidence
from siltworks.operators import selection, tags, trees, vectors
from siltworks.operators.predicates import any_case_contains
from siltworks.plans.guard import Plan, Profile, run
from siltworks.queries.graphs import EDGES, places
from siltworks.registry import query
from siltworks.sources.readers import table

money = lambda c: F.col(c).cast("decimal(18,2)")
DISTRIBUTION = Profile(
    key="lines.distribution",
    columns={"line": "l_orderkey", "year": "year", "province": "n_name", "major": "p_type", "task": "p_name", "count": "l_quantity"},
    metrics={"sum:count": lambda: F.sum(money("l_quantity")), "count:line": lambda: F.count("*")},
    filters=frozenset({"year", "province", "major", "task", "line"}),
    group_by=frozenset({"year", "province", "major"}),
    contains=frozenset({"major", "task"}),
    default_order=(("line", "asc"), ("count", "asc"), ("task", "asc"), ("province", "asc")),
    tag_types=frozenset({"brand", "type"}),
    tag_target="l_partkey",
)
LINES = """FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return made.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("year", F.year("l_shipdate"))


def cells(spark: SparkSession, d: str, values: list) -> DataFrame:
    """event_id and ``cell``, the values in turn."""
    return table(spark, d, "events").select("event_id", F.get(F.array(*[F.lit(v) for v in values]).cast("array<string>"), (F.col("event_id") % len(values)).cast("int")).alias("cell"))


def in_turn(*columns: tuple[str, list]) -> str:
    """SQL: event_id with each column's values in turn."""
    text = lambda v: "NULL" if v is None else repr(v) if isinstance(v, (int, bool)) else "'" + v.replace("'", "''") + "'"
    return "SELECT event_id, " + ", ".join(f"([{', '.join(map(text, vs))}])[event_id % {len(vs)} + 1] AS {n}" for n, vs in columns) + " FROM events"


@query(f"""SELECT year(l_shipdate) AS year, round(sum(l_quantity::DECIMAL(18,2))::DOUBLE, 2) AS metric_value, count(*) AS record_count {LINES}
WHERE contains(p_type, 'ECONOMY') AND n_nationkey < 12 AND year(l_shipdate) >= 1993 GROUP BY 1 ORDER BY 1 LIMIT 50""")
def r2_12_distribution_filters(spark: SparkSession, d: str) -> DataFrame:
    names = [r["n_name"] for r in table(spark, d, "nation").filter("n_nationkey < 12").select("n_name").collect()]  # a request's list of at most 12
    plan = Plan(filters={"major": "ECONOMY", "province": names, "year": {"gte": 1993}}, group_by=("year",), metrics=("sum:count",))
    return run(plan, DISTRIBUTION, lines(spark, d))


@query(f"""SELECT l_orderkey AS line, year(l_shipdate) AS year, n_name AS province, p_type AS major, p_name AS task, l_quantity AS count {LINES}
WHERE contains(p_type, 'O') AND contains(p_name, 'widget') AND l_orderkey IN (1, 2, 3, 4, 5, 6, 7, 32, 33, 34) ORDER BY 1, 6, 5, 3 LIMIT 50""")
def r2_13_competency_filters(spark: SparkSession, d: str) -> DataFrame:
    return run(Plan(filters={"major": "O", "task": "widget", "line": [1, 2, 3, 4, 5, 6, 7, 32, 33, 34]}), DISTRIBUTION, lines(spark, d))


def payload(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """The fields of a record under their names, and no others."""
    return rows.select(*[F.col(c).alias(n) for n, c in fields.items()])


@query("""SELECT o_orderkey AS id, o_custkey AS dataset_id, o_orderdate AS published_at, o_orderpriority AS title, o_totalprice AS salary, o_orderstatus AS status, c_name AS company, c_mktsegment AS industry FROM orders JOIN customer ON o_custkey = c_custkey""")
def r2_22_record_payload(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return payload(rows, {"id": "o_orderkey", "dataset_id": "o_custkey", "published_at": "o_orderdate", "title": "o_orderpriority", "salary": "o_totalprice", "status": "o_orderstatus", "company": "c_name", "industry": "c_mktsegment"})


@query(f"SELECT l_orderkey AS id, l_linenumber AS row_no, year(l_shipdate) AS year, n_name AS province, p_type AS major, l_quantity AS distribution_count {LINES}")
def r2_23_distribution_payload(spark: SparkSession, d: str) -> DataFrame:
    return payload(lines(spark, d), {"id": "l_orderkey", "row_no": "l_linenumber", "year": "year", "province": "n_name", "major": "p_type", "distribution_count": "l_quantity"})


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def r3_21_without_large_orders(spark: SparkSession, d: str) -> DataFrame:
    large = table(spark, d, "orders").filter("o_totalprice > 300000")
    return table(spark, d, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""SELECT event_id, s.s_name AS title, CASE WHEN s_name ILIKE '%3%' THEN 2 ELSE 0 END + CASE WHEN event_type ILIKE '%c%' THEN 1 ELSE 0 END AS score
FROM events LEFT JOIN supplier s ON user_id % 20 = s_suppkey WHERE coalesce(s_name ILIKE '%3%', false) OR coalesce(event_type ILIKE '%c%', false) ORDER BY score DESC, event_id LIMIT 8""")
def r3_09_ranked_outer_join(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").join(table(spark, d, "supplier"), F.col("user_id") % 20 == F.col("s_suppkey"), "left")
    title, content = (F.coalesce(any_case_contains(F.col(c), v), F.lit(False)) for c, v in (("s_name", "3"), ("event_type", "c")))
    scored = rows.filter(title | content).select("event_id", F.col("s_name").alias("title"), (2 * title.cast("int") + content.cast("int")).alias("score"))
    return selection.page(scored, F.col("score").desc(), F.col("event_id"), limit=8)


SUBTREE = f"WITH RECURSIVE {EDGES}, w AS (SELECT 'r1' AS node UNION SELECT e.child FROM w JOIN e ON e.parent = w.node)"


@query(f"{SUBTREE} SELECT DISTINCT node FROM w")
def r3_13_subtree(spark: SparkSession, d: str) -> DataFrame:
    return selection.subtree(places(spark, d), "r1")


@query("""WITH x AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS level FROM events)
SELECT event_id AS node, level::INT AS level FROM x""")
def r3_13_walk_to_the_end(spark: SparkSession, d: str) -> DataFrame:
    """From each user's first event to the next ones, one by one; the last leads back to the first."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").select("user_id", "ts", "event_id")
    first = F.first("event_id").over(w)
    edges = rows.select(F.col("event_id").alias("parent"), F.coalesce(F.lead("event_id").over(w), first).alias("child"))
    roots = rows.withColumn("first", first).filter("first = event_id").select(F.col("event_id").alias("node"))
    return trees.reach(edges, roots)


@query(f"{SUBTREE} SELECT o_orderkey FROM orders WHERE 'c' || o_custkey IN (SELECT node FROM w)")
def r3_15_subtree_chunks(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("leaf"))
    return tags.within(chunks, "leaf", selection.subtree(places(spark, d), "r1").select(F.col("node").alias("id"))).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) ORDER BY 1")
def r3_17_chunks_of_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("id"))
    return tags.within(table(spark, d, "orders"), "o_custkey", nodes).select("o_orderkey").orderBy("o_orderkey")


@query("""WITH seed AS (SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%7%'), e AS (SELECT c_custkey, o_orderkey FROM seed JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus <> 'P')
SELECT DISTINCT 'customer' AS kind, c_custkey AS id FROM seed UNION SELECT DISTINCT 'order', o_orderkey FROM e""")
def r3_18_role_subgraph(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by title, their edges but one kind, and what the edges lead to; a node comes once."""
    seed = table(spark, d, "customer").filter(any_case_contains(F.col("c_name"), "7")).select("c_custkey")
    edges = seed.join(table(spark, d, "orders").filter("o_orderstatus <> 'P'"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey")
    nodes = seed.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id")).unionByName(edges.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id")))
    return nodes.dropDuplicates(["kind", "id"])


@query(f"""SELECT year(l_shipdate) AS year, n_name AS province, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS total, count(*) AS n {LINES} GROUP BY 1, 2""")
def r4_04_grouped_distribution(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).groupBy("year", F.col("n_name").alias("province")).agg(F.sum(money("l_quantity")).cast("double").alias("total"), F.count("*").alias("n"))


@query("""SELECT c_mktsegment AS category, r_name AS task, count(o_orderkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def r4_05_grouped_abilities(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy(F.col("c_mktsegment").alias("category"), F.col("r_name").alias("task")).agg(F.count("o_orderkey").alias("n"))


_cos = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
_top = "SELECT q.vec_id AS query, v.vec_id AS id FROM v q JOIN v ON q.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {score} DESC, v.vec_id) <= 10"


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, (embedding::DOUBLE[])[1:32] AS h FROM embeddings),
x AS ({_top.format(score=_cos.format(a='q.e', b='v.e'))}), y AS ({_top.format(score=_cos.format(a='q.h', b='v.h'))})
SELECT x.query, round(count(y.id) / count(*), 6)::DOUBLE AS recall FROM x LEFT JOIN y ON x.query = y.query AND x.id = y.id GROUP BY 1""")
def r4_25_recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Recall of a search over the first half of each vector, by the exact one, for every query row."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", F.slice("embedding", 1, 32).alias("half"))

    def top(vector: str) -> DataFrame:
        probes = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col(vector).alias("probe"))
        return vectors.search(rows, probes, -1.0, 10, vector=vector)

    return selection.recall_at(top("embedding"), top("half")).select("query", F.round("recall", 6).alias("recall"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name DESC, c_custkey LIMIT 20 OFFSET 40")
def r6_04_paged_list(spark: SparkSession, d: str) -> DataFrame:
    return selection.page(table(spark, d, "customer").select("c_custkey", "c_name"), F.col("c_name").desc(), F.col("c_custkey"), limit=20, offset=40)


@query("SELECT event_id, value, row_number() OVER (ORDER BY value DESC NULLS LAST, event_id) AS place FROM events WHERE event_id < 200")
def r6_06_rerank(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    hits = table(spark, d, "events").filter("event_id < 200").select("event_id", "value")  # one request's hits
    return selection.rerank(hits, "value", "event_id").withColumn("place", F.row_number().over(Window.orderBy(F.col("value").desc_nulls_last(), "event_id")))


@query("""SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC NULLS LAST, event_id) AS place FROM events""")
def r6_06_reranked_requests(spark: SparkSession, d: str) -> DataFrame:
    """All events as hits of a request for their type, each with the place that the reranking gives it."""
    return selection.reranked(table(spark, d, "events").select("event_type", "event_id", "value"), ["event_type"], "value", "event_id")


@query("""WITH RECURSIVE h AS (SELECT o_custkey AS k, o_orderkey AS id, o_totalprice AS s, (o_orderkey % 900 + 300)::BIGINT AS n FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC, id) AS i FROM h),
w AS (SELECT k, 0::BIGINT AS i, 0::BIGINT AS used, 0::BIGINT AS held, NULL::BIGINT AS id, 0.0::DOUBLE AS s, 0::BIGINT AS n, false AS fits FROM (SELECT DISTINCT k FROM r)
UNION ALL SELECT r.k, r.i, w.used + CASE WHEN w.held < 3 AND (w.held = 0 OR w.used + r.n <= 1600) THEN r.n ELSE 0 END, w.held + CASE WHEN w.held < 3 AND (w.held = 0 OR w.used + r.n <= 1600) THEN 1 ELSE 0 END, r.id, r.s, r.n, w.held < 3 AND (w.held = 0 OR w.used + r.n <= 1600)
FROM w JOIN r ON r.k = w.k AND r.i = w.i + 1)
SELECT k, id, s, n, (held - 1)::INT AS place FROM w WHERE fits""")
def r6_10_answer_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("s"), (F.col("o_orderkey") % 900 + 300).alias("n"))
    return selection.within_budget(rows, "k", "s", "id", "n", items=3, total=1600)


def tag_index(spark: SparkSession, d: str) -> DataFrame:
    """Tags of parts: two types, with vectors of as many dimensions as the embeddings have."""
    parts, vecs = table(spark, d, "part"), table(spark, d, "embeddings").select("vec_id", "embedding")
    brand = parts.select(F.lit("brand").alias("tag_type"), F.col("p_brand").alias("tag_value"), F.col("p_partkey").alias("target_id"))
    kind = parts.select(F.lit("type").alias("tag_type"), F.col("p_type").alias("tag_value"), F.col("p_partkey").alias("target_id"))
    both = brand.unionByName(kind).withColumn("tag_value_normalized", F.lower(F.regexp_replace("tag_value", "[# ]", "")))
    return both.join(vecs, F.col("vec_id") == F.col("target_id") - 1, "left").drop("vec_id")


INDEX = """ix AS (SELECT *, lower(regexp_replace(tag_value, '[# ]', '', 'g')) AS norm FROM (SELECT 'brand' AS tag_type, p_brand AS tag_value, p_partkey AS id FROM part UNION ALL SELECT 'type', p_type, p_partkey FROM part))"""


@query(f"""WITH {INDEX}, h AS (SELECT 'b' AS bucket, id FROM ix WHERE tag_type = 'brand' AND tag_value = 'Brand#13' UNION SELECT 'b', id FROM ix WHERE tag_type = 'brand' AND norm = 'brand5'
UNION SELECT 't', id FROM ix WHERE tag_type = 'type' AND norm = 'economy')
SELECT id, count(DISTINCT bucket)::DOUBLE AS score FROM h GROUP BY id HAVING count(DISTINCT bucket) = 2""")
def r8_13_tag_driven_targets(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.createDataFrame([("b", "brand", "Brand#13"), ("b", "brand", "brand5"), ("t", "type", "economy")], "bucket string, tag_type string, value string")
    return tags.resolve(tag_index(spark, d), wanted, "l1|l1.5|nosuch", "AND")


_cosv = _cos.format(a="q.e", b="v.e")


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query, p_partkey AS id, {_cosv} AS score FROM v q JOIN v ON true JOIN part ON p_partkey - 1 = v.vec_id WHERE q.vec_id IN (0, 7))
SELECT 'b' || query AS bucket, id, round(score, 6) AS score FROM s WHERE score >= 0.1 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 20""")
def r8_10_semantic_tags(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "embeddings").filter("vec_id in (0, 7)").select(F.concat(F.lit("b"), F.col("vec_id").cast("string")).alias("bucket"), F.lit("brand").alias("tag_type"), F.col("vec_id").cast("string").alias("value"), F.col("embedding").alias("probe"))
    return tags.semantic(tag_index(spark, d), wanted, 0.1, 20).withColumn("score", F.round("score", 6))


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT p_partkey AS id, {_cosv} AS score FROM v q JOIN v ON true JOIN part ON p_partkey - 1 = v.vec_id WHERE q.vec_id = 0 QUALIFY row_number() OVER (ORDER BY score DESC, id) <= 20)
SELECT id, round(score, 6) AS score FROM s WHERE score >= 0.1""")
def r8_15_any_semantic_tag(spark: SparkSession, d: str) -> DataFrame:
    """Targets that any type finds, each with its best score."""
    probe = table(spark, d, "embeddings").filter("vec_id = 0").select("embedding")
    wanted = probe.select(F.lit("any").alias("bucket"), F.explode(F.array(F.lit("brand"), F.lit("type"))).alias("tag_type"), F.lit("x").alias("value"), F.col("embedding").alias("probe"))
    return tags.semantic(tag_index(spark, d), wanted, 0.1, 20).groupBy("id").agg(F.round(F.max("score"), 6).alias("score"))


@query("SELECT vec_id AS n FROM embeddings WHERE false UNION ALL SELECT vec_id FROM embeddings WHERE vec_id % 50 = 1")
def r8_03_empty_and_absent_sets(spark: SparkSession, d: str) -> DataFrame:
    """An empty set of ids finds nothing, an absent one filters nothing."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("n"))
    return tags.within(rows, "n", rows.select(F.col("n").alias("id")).filter("false")).unionByName(tags.within(rows.filter("n % 50 = 1"), "n", None))


FOLDS = [" ＡＢＣ－１２ ", "ﬁne", None, "Ⅳ级", "plain", "ｱｲｳ"]
FOLDED = ["abc-12", "fine", "", "iv级", "plain", "アイウ"]


@query(in_turn(("folded", FOLDED)))
def r9_01_compatibility_fold(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d, FOLDS).select("event_id", fold.folded(F.col("cell")).alias("folded"))


TAGS = ["北京市", "京", "内蒙古自治区", "Ｊａｖａ（基础）", "a [b] (c(d)e) F", None, "市", "粤", "朝 阳 区"]
TAGGED = ["北京", "北京", "内蒙古", "java", "af", "", "市", "广东", "朝阳"]


@query(in_turn(("tag", TAGGED)))
def r9_04_tag_values(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d, TAGS).select("event_id", fold.tag_value(F.col("cell"), fold.REGION_SUFFIXES).alias("tag"))


NUMERALS = ["一", "十", "十一", "二十", "二十一", "一百", "一百零一", "两百", "三千", "12", "零", "x", None, "一万二"]
NUMBERS = [1, 10, 11, 20, 21, 100, 101, 200, 3000, 12, None, None, None, 10002]


@query(in_turn(("n", NUMBERS)))
def r9_29_numerals(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d, NUMERALS).select("event_id", fold.numeral(F.col("cell")).alias("n"))


HEADINGS = ["1.2.3 Scope", "2、范围", "第十二章 总论", " 第 三 节 方法", "项目二 拍摄", "Chapter 4 Ends", "chapterless", None, "1.2.3.4.5 deep", "3) item"]
TOKENS = ["1.2.3", "2", "第十二章", "第三节", "二", "Chapter 4", None, None, "1.2.3.4", "3"]
PATHS = ["1/2/3", "2", "12", "3", "2", "4", "", "", "1/2/3/4", "3"]


@query(in_turn(("token", TOKENS), ("path", PATHS)))
def r9_30_heading_numbers(spark: SparkSession, d: str) -> DataFrame:
    made = cells(spark, d, HEADINGS).select("event_id", fold.heading_number(F.col("cell")).alias("h"))
    return made.select("event_id", "h.token", F.coalesce(F.array_join(F.col("h.path").cast("array<string>"), "/"), F.lit("")).alias("path"))


MAJORS = ["电子商务专业教学标准", "软件技术专业简介", "计算机类", "财经商贸大类", " 会计 ", "", None, "电子商务（跨境方向）", "护理专业教学标准教学标准"]
MAJOR_NAMES = ["电子商务", "软件技术", "计算机", "财经商贸大类", "会计", None, None, "电子商务（跨境方向）", "护理"]


@query(in_turn(("major", MAJOR_NAMES)))
def r11_05_major_names(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d, MAJORS).select("event_id", fold.major_name(F.col("cell")).alias("major"))


@query("""SELECT event_id, array_to_string(CASE WHEN event_type = event_id::VARCHAR THEN [event_type] ELSE [event_type, event_id::VARCHAR] END, ',') AS ids, CASE WHEN event_id % 2 = 0 THEN 'old' ELSE 'new' END AS scalar FROM events""")
def r9_36_merged_maps(spark: SparkSession, d: str) -> DataFrame:
    old = F.create_map(F.lit("ids"), F.array("event_type"), F.lit("scalar"), F.when(F.col("event_id") % 2 == 0, F.array(F.lit("old"))).otherwise(F.array().cast("array<string>")))
    new = F.create_map(F.lit("ids"), F.array("event_type", F.col("event_id").cast("string")), F.lit("scalar"), F.array(F.lit("new")))
    merged = fold.merged_maps(old, new)
    return table(spark, d, "events").select("event_id", F.array_join(merged["ids"], ",").alias("ids"), F.get(merged["scalar"], F.lit(0)).alias("scalar"))


@query("""SELECT page_id, greatest(0.0, least(1.0, round((CASE WHEN page_id % 2 = 0 THEN 0.88 ELSE 0.66 END) - CASE WHEN length(html) < 600 THEN 0.18 ELSE 0 END - CASE WHEN page_id % 5 = 0 THEN 0.18 ELSE 0 END - CASE WHEN contains(lower(html), 'cookie') THEN 0.12 ELSE 0 END, 2)))::DOUBLE AS confidence FROM pages""")
def r9_25_content_confidence(spark: SparkSession, d: str) -> DataFrame:
    base = F.when(F.col("page_id") % 2 == 0, 0.88).otherwise(0.66)
    made = selection.confidence(base, (F.length("html") < 600, 0.18), (F.col("page_id") % 5 == 0, 0.18), (F.lower("html").contains("cookie"), 0.12))
    return table(spark, d, "pages").select("page_id", made.alias("confidence"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE '***redacted***' END AS suggestion, event_type AS final, 0 AS n_public, 1 AS n_full FROM events""")
def r9_23_redacted_trail(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.lit("other"))
    trail = F.array(F.struct(said.alias("ai_suggestion"), F.col("event_type").alias("final_value"), F.lit(0.4).alias("ai_confidence")))
    first = F.get(selection.redacted(trail, "operator"), F.lit(0))
    return table(spark, d, "events").select("event_id", first["ai_suggestion"].alias("suggestion"), first["final_value"].alias("final"), F.size(selection.redacted(trail, "public")).alias("n_public"), F.size(selection.redacted(trail, "full")).alias("n_full"))


@query(in_turn(("weak", [True, True, True, False, False, True])))
def r8_27_weak_evidence(spark: SparkSession, d: str) -> DataFrame:
    rows = cells(spark, d, ["t|学习目标 一", " 目录 1", "知识回顾：", "正文 目录", None, "目 录"])
    title = F.when(F.col("cell").startswith("t|"), F.col("cell"))
    return rows.select("event_id", weak_evidence(title, F.col("cell")).alias("weak"))


@query("""WITH g AS (SELECT event_id, event_id % 8 AS kept, event_id % 3 AS facts, event_id % 2 AS links, (event_id % 11) / 10 AS single, (event_id % 7) / 20 AS multi, (event_id % 5) / 10 AS gen, (event_id % 4) / 2 AS per FROM events)
SELECT event_id, array_to_string(list_filter([CASE WHEN kept >= 3 AND links = 0 THEN 'no_chunk_context_links' END, CASE WHEN kept >= 5 AND single > 0.9 AND per > 1.5 THEN 'over_localized_single_chunk_graph' END,
CASE WHEN kept >= 3 AND gen > 0.3 THEN 'generic_entity_ratio_high' END, CASE WHEN kept >= 5 AND multi < 0.1 THEN 'multi_chunk_context_low' END], lambda x: x IS NOT NULL), ',') AS warnings, facts = 0 AS blocked FROM g""")
def r11_13_graph_gate(spark: SparkSession, d: str) -> DataFrame:
    m = lambda n: F.col("event_id") % n
    warnings, blockers = graph_gate(m(8), m(3), m(2), m(11) / 10, m(7) / 20, m(5) / 10, m(4) / 2)
    return table(spark, d, "events").select("event_id", F.array_join(warnings, ",").alias("warnings"), (F.size(blockers) > 0).alias("blocked"))


@query(f"""SELECT year(l_shipdate) AS year, round(sum(l_quantity::DECIMAL(18,2))::DOUBLE, 2) AS metric_value, count(*) AS record_count {LINES}
WHERE p_brand IN ('Brand#13', 'Brand#5') AND p_type = 'ECONOMY' GROUP BY 1 ORDER BY 1 LIMIT 50""")
def r2_06_tagged_plan(spark: SparkSession, d: str) -> DataFrame:
    plan = Plan(tags={"brand": ["Brand#13", "Brand#5"], "type": ["ECONOMY"]}, group_by=("year",), metrics=("sum:count",))
    return run(plan, DISTRIBUTION, lines(spark, d), tag_index(spark, d).select("tag_type", "tag_value", "target_id"))


@query("SELECT p_partkey FROM part WHERE p_name ILIKE '%large%' OR p_name ILIKE '%big%' OR p_name ILIKE '%bolt%' OR p_name ILIKE '%screw%'")
def r2_16_expanded_keywords(spark: SparkSession, d: str) -> DataFrame:
    from siltworks.operators.predicates import any_column_contains

    terms = selection.expand_terms(["large", "bolt", "large"], {"large": ["big"], "bolt": ["screw", "bolt"]})
    return table(spark, d, "part").filter(any_column_contains([F.col("p_name")], terms)).select("p_partkey")


TITLES = ["一、拍摄设备", "设备", "拍摄的相关设备", None, "常见拍摄设备介绍", "第三章 摄影", "拍摄设备", "拍摄设计设备"]


@query(in_turn(("score", [10004, 0, 9004, 0, 10004, 0, 10004, 3])))
def r8_25_title_score(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d, TITLES).select("event_id", titles.title_score(titles.query_key(F.lit("拍摄设备？")), F.col("cell")).cast("int").alias("score"))


@query("SELECT event_id, ([1.0, 0.24, 0.0, 0.0, 0.0, 0.24, 0.0]::DOUBLE[])[event_id % 7 + 1] AS score FROM events")
def r8_26_section_relevance(spark: SparkSession, d: str) -> DataFrame:
    rows = cells(spark, d, ["一、拍摄设备", "设备维护", "备", "概述", None, "清单的常见用途", "摄影"])
    return rows.select("event_id", F.round(titles.section_relevance(F.lit("拍摄设备清单"), F.col("cell")), 6).alias("score"))


ASKED = ["Q: What is it?\nA: It is an answer.\nQ: And more?\nA: More of the same.", "问：什么是拍摄设备\n答：就是用来拍摄的各种设备", "Question 1: Which one?\nAnswer 1: The second of them.", "Q: x\nA: short", None, "plain text"]


@query("SELECT event_id, ([2, 1, 1, 0, 0, 0])[event_id % 6 + 1] AS n, (['What is it?', '什么是拍摄设备', 'Which one?', NULL, NULL, NULL])[event_id % 6 + 1] AS question, (['More of the same.', '就是用来拍摄的各种设备', 'The second of them.', NULL, NULL, NULL])[event_id % 6 + 1] AS answer FROM events")
def r10_21_pairs_by_pattern(spark: SparkSession, d: str) -> DataFrame:
    rows = cells(spark, d, ASKED).select("event_id", titles.qa_pairs(F.col("cell")).alias("p"))
    return rows.select("event_id", F.size("p").alias("n"), F.get("p", F.lit(0))["question"].alias("question"), F.get("p", F.size("p") - 1)["answer"].alias("answer"))


@query("""SELECT doc_id, sha256(regexp_replace(text, '(?i)(sk-[A-Za-z0-9_-]{20,}|ragflow-[A-Za-z0-9_-]{20,}|Bearer\\s+[A-Za-z0-9._\\-]{16,})', '***redacted***', 'g')) AS text FROM documents""")
def r9_21_scrubbed_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(clean.scrub_secrets(F.col("text")), 256).alias("text"))


@query("SELECT event_id, sha256((['abc-12', 'fine', '', 'iv级', 'plain', 'アイウ'])[event_id % 6 + 1] || '|' || lower(trim(event_type))) AS fp FROM events")
def r9_02_folded_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    rows = cells(spark, d, FOLDS).join(table(spark, d, "events").select("event_id", "event_type"), "event_id")
    return rows.select("event_id", clean.fingerprint(fold.folded(F.col("cell")), F.col("event_type")).alias("fp"))


@query(in_turn(("field", ["salary", "title", None, None, None, "title"])))
def r9_37_alias_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Headers by what they are called once folded."""
    names = fold.lookup({"薪资(元)": "salary", "job": "title"})
    return cells(spark, d, ["薪资（元） ", "ＪＯＢ", "jobs", None, "", " Job"]).select("event_id", F.try_element_at(names, fold.folded(F.col("cell"))).alias("field"))


def merged_fragments(rows: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """(key, text, n): texts of a key joined in order; rows with a null or blank key pass as they are."""
    keyed = rows.filter(F.trim(key) != "").groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), ";").alias(text), F.count("*").alias("n"))
    return keyed.unionByName(rows.filter(F.col(key).isNull() | (F.trim(key) == "")).select(key, text, F.lit(1).cast("long").alias("n")))


@query("""WITH x AS (SELECT nullif(p_brand, 'Brand#5') AS k, p_name AS t, p_partkey AS o FROM part) SELECT k, string_agg(t, ';' ORDER BY o) AS t, count(*) AS n FROM x WHERE k IS NOT NULL GROUP BY k UNION ALL SELECT k, t, 1 FROM x WHERE k IS NULL""")
def r15_15_fragments_and_rest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.nullif("p_brand", F.lit("Brand#5")).alias("k"), F.col("p_name").alias("t"), F.col("p_partkey").alias("o"))
    return merged_fragments(rows, "k", "t", "o")


def candidate_chunks(chunks: DataFrame, kinds: list[str], least: int) -> DataFrame:
    """Adds ``skipped``: why a chunk (chunk_type, content) is no candidate, null for candidates."""
    why = F.when(~F.col("chunk_type").isin(kinds) | F.col("chunk_type").isNull(), "unsupported_type").when(F.trim(F.coalesce("content", F.lit(""))) == "", "empty_content").when(F.length(F.trim("content")) < least, "too_short")
    return chunks.withColumn("skipped", why)


@query("""SELECT CASE WHEN source IS NULL OR source NOT IN (SELECT DISTINCT source FROM documents ORDER BY source LIMIT 2) THEN 'unsupported_type' WHEN trim(coalesce(text, '')) = '' THEN 'empty_content' WHEN length(trim(text)) < 200 THEN 'too_short' END AS skipped, count(*) AS n FROM documents GROUP BY 1""")
def r11_08_skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("source").alias("chunk_type"), F.col("text").alias("content"))
    kinds = [r["chunk_type"] for r in docs.select("chunk_type").filter("chunk_type is not null").distinct().orderBy("chunk_type").limit(2).collect()]
    return candidate_chunks(docs, kinds, 200).groupBy("skipped").agg(F.count("*").alias("n"))


@query("""SELECT o_custkey AS major, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS graph FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_name ILIKE '%1%' GROUP BY 1""")
def r11_06_latest_graphs(spark: SparkSession, d: str) -> DataFrame:
    from siltworks.operators.windows import latest

    rows = table(spark, d, "orders").join(table(spark, d, "customer").filter(any_case_contains(F.col("c_name"), "1")), F.col("o_custkey") == F.col("c_custkey"))
    return latest(rows.select(F.col("o_custkey").alias("major"), "o_orderkey", "o_orderdate"), "major", "o_orderdate", "o_orderkey").select("major", F.col("o_orderkey").alias("graph"))


@query("""SELECT n_nationkey AS dataset, 'n' || n_nationkey || '>s' || s_suppkey AS edge FROM nation JOIN supplier ON s_nationkey = n_nationkey UNION SELECT n_nationkey, 'n' || n_nationkey || '>c' || c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey""")
def r11_02_ability_graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges from a dataset to what belongs to it, of two kinds, each once."""
    edge = lambda kind, key: F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(f">{kind}"), F.col(key).cast("string")).alias("edge")
    nation = table(spark, d, "nation").select("n_nationkey")
    s = nation.join(table(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("n_nationkey").alias("dataset"), edge("s", "s_suppkey"))
    c = nation.join(table(spark, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_nationkey").alias("dataset"), edge("c", "c_custkey"))
    return s.unionByName(c).distinct()


def first_scope(scopes: list[DataFrame]) -> DataFrame:
    """The first of the scopes that has rows, else the last: a request is widened only while it finds nothing."""
    for rows in scopes[:-1]:
        if not rows.isEmpty():
            return rows
    return scopes[-1]


@query("SELECT vec_id FROM embeddings WHERE label = 1")
def r8_29_scope_fallback(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return first_scope([rows.filter("label = -5"), rows.filter("label = 1"), rows]).select("vec_id")

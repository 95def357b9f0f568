"""Trees, graphs, governance rules and windows over the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltworks.operators.trees import breadcrumbs, descendants
from siltworks.registry import query
from siltworks.sources.readers import table
from siltworks.streaming.events import sessions, sliding


def places(spark: SparkSession, d: str) -> DataFrame:
    """Parent-child edges: region, nation, customer."""
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    nations = table(spark, d, "nation").select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child"))
    return nations.unionByName(table(spark, d, "customer").select(name("n", "c_nationkey").alias("parent"), name("c", "c_custkey").alias("child")))


EDGES = "e AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"


@query(f"WITH RECURSIVE {EDGES}, w AS (SELECT 'r1' AS node, 0 AS level UNION SELECT e.child, w.level + 1 FROM w JOIN e ON e.parent = w.node WHERE w.level < 5) SELECT node, min(level) AS level FROM w GROUP BY 1")
def r3_14_bounded_subtree(spark: SparkSession, d: str) -> DataFrame:
    return descendants(places(spark, d), spark.sql("SELECT 'r1' AS node"), 5)


@query(f"WITH {EDGES} SELECT c.child AS leaf, b.parent || '/' || c.parent AS path FROM e c JOIN e b ON b.child = c.parent WHERE c.child LIKE 'c%'")
def r3_16_breadcrumbs(spark: SparkSession, d: str) -> DataFrame:
    e = places(spark, d)
    return breadcrumbs(e, e.filter("child like 'c%'").selectExpr("child AS node"), 3).select("leaf", F.concat_ws("/", "path").alias("path"))


@query("""SELECT DISTINCT 'customer' AS kind, c_mktsegment || '>' || n_name AS edge FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT DISTINCT 'nation', n_name || '>' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey""")
def r11_01_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    a = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.lit("customer").alias("kind"), F.concat_ws(">", "c_mktsegment", "n_name").alias("edge"))
    b = nation.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit("nation").alias("kind"), F.concat_ws(">", "n_name", "r_name").alias("edge"))
    return a.unionByName(b).distinct()


@query("""SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)""")
def r11_14_known_endpoints(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    orders, parts = table(spark, d, "orders").filter("o_orderstatus = 'F'"), table(spark, d, "part").filter("p_size > 25")
    return edges.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi")


@query("""SELECT doc_id, CASE WHEN quality IS NULL THEN 'review' WHEN toxic = 1 THEN 'review' WHEN quality = 0 THEN 'review' ELSE 'adopted' END AS decision FROM documents LEFT JOIN labels USING (doc_id)""")
def r12_04_overall_status(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    trail = F.array(F.col("quality").isNull(), F.coalesce(F.col("toxic") == 1, F.lit(False)), F.coalesce(F.col("quality") == 0, F.lit(False)))
    return x.select("doc_id", F.when(F.exists(trail, lambda t: t), "review").otherwise("adopted").alias("decision"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) > 1 THEN 'archived' ELSE o_orderstatus END AS status FROM orders""")
def r12_06_single_available(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey", "o_orderstatus").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    return table(spark, d, "orders").select("o_orderkey", F.when((F.col("o_orderstatus") == "F") & (F.row_number().over(w) > 1), "archived").otherwise(F.col("o_orderstatus")).alias("status"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 3 THEN 'too_few' WHEN l_discount > 0.08 THEN 'discount' WHEN l_returnflag = 'R' THEN 'returned' END AS reason FROM lineitem""")
def r12_08_first_failing_rule(spark: SparkSession, d: str) -> DataFrame:
    rules = [F.when(F.expr(c), F.lit(k)) for k, c in (("too_few", "l_quantity < 3"), ("discount", "l_discount > 0.08"), ("returned", "l_returnflag = 'R'"))]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(*rules).alias("reason"))


@query("SELECT source, sha256(coalesce(text, '')) AS checksum, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def r12_12_checksum_duplicates(spark: SparkSession, d: str) -> DataFrame:
    checksum = F.sha2(F.coalesce("text", F.lit("")), 256)
    return table(spark, d, "documents").groupBy("source", checksum.alias("checksum")).agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 60 WHEN 1 THEN 300 ELSE 900 END AS wait FROM events")
def r13_04_retry_backoff(spark: SparkSession, d: str) -> DataFrame:
    steps = F.array(F.lit(60), F.lit(300), F.lit(900))
    return table(spark, d, "events").select("event_id", F.get(steps, F.least(F.col("event_id") % 4, F.lit(2)).cast("int")).alias("wait"))


@query("""SELECT c_mktsegment, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS nations, min(c_name) AS first_name FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def r15_13_position_merge(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return x.groupBy("c_mktsegment").agg(F.concat_ws(",", F.array_sort(F.collect_set("n_name"))).alias("nations"), F.min("c_name").alias("first_name"))


@query("""WITH x AS (SELECT conv_id, turn, turn >= coalesce(lag(turn) OVER (PARTITION BY conv_id ORDER BY turn), turn) AS fine FROM conversations) SELECT round(avg(fine_all::INT), 4) AS share FROM (SELECT conv_id, bool_and(fine) AS fine_all FROM x GROUP BY 1)""")
def r15_10_step_order(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = table(spark, d, "conversations").select("conv_id", (F.col("turn") >= F.coalesce(F.lag("turn").over(w), F.col("turn"))).alias("fine"))
    return x.groupBy("conv_id").agg(F.bool_and("fine").alias("fine")).agg(F.round(F.avg(F.col("fine").cast("int")), 4).alias("share"))


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value::DECIMAL(18,2))::DOUBLE, 2) AS total FROM events GROUP BY ALL""")
def ext_01_tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    return sliding(table(spark, d, "events"), "1 hour", None)


@query("""WITH x AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
y AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x)
SELECT user_id, min(ts) AS start, count(*) AS n FROM y GROUP BY user_id, s""")
def ext_02_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions(table(spark, d, "events"), "30 minutes")

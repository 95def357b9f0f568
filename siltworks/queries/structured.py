"""Guarded plans, filters, joins and aggregates over the order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltworks.operators.predicates import any_case_contains, any_column_contains, matches, named_in, year_or_all
from siltworks.operators.ordered import dealt_left, percentiles
from siltworks.operators.windows import first_by
from siltworks.plans.guard import Plan, Profile, run
from siltworks.registry import query
from siltworks.sources.readers import table

money = lambda c: F.col(c).cast("decimal(18,2)")
ORDERS = Profile(
    key="orders.by_priority",
    columns={"order": "o_orderkey", "status": "o_orderstatus", "priority": "o_orderpriority", "price": "o_totalprice", "segment": "c_mktsegment"},
    metrics={"count:record": lambda: F.count("*"), "sum:price": lambda: F.sum(money("o_totalprice")), "avg:price": lambda: F.avg(money("o_totalprice"))},
    filters=frozenset({"status", "priority", "price", "segment", "order"}),
    group_by=frozenset({"priority", "segment", "status"}),
    contains=frozenset({"priority"}),
    default_order=(("order", "asc"),),
)


def orders_with_customer(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))


@query("""SELECT c_mktsegment AS segment, round(coalesce(sum(o_totalprice::DECIMAL(18,2))::DOUBLE, 0), 2) AS metric_value, count(*) AS record_count
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('O', 'F') AND o_totalprice BETWEEN 50000 AND 300000 GROUP BY 1 ORDER BY 1 LIMIT 50""")
def r2_01_guarded_grouped_plan(spark: SparkSession, d: str) -> DataFrame:
    plan = Plan(filters={"status": ["O", "F"], "price": {"between": (50000, 300000)}}, group_by=("segment",), metrics=("sum:price",))
    return run(plan, ORDERS, orders_with_customer(spark, d))


@query("""SELECT o_orderkey AS "order", o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS price, c_mktsegment AS segment
FROM orders JOIN customer ON o_custkey = c_custkey WHERE contains(o_orderpriority, 'HIGH') AND o_totalprice >= 100000 ORDER BY 1 LIMIT 50 OFFSET 20""")
def r2_08_guarded_record_list(spark: SparkSession, d: str) -> DataFrame:
    return run(Plan(filters={"priority": "HIGH", "price": {"gte": 100000}}, offset=20), ORDERS, orders_with_customer(spark, d))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount <= 0.05")
def r2_09_range_operators(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    return rows.filter(matches(F.col("l_quantity"), {"between": (10, 20)}) & matches(F.col("l_discount"), {"lte": 0.05})).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%WIDG_T%'")
def r2_14_any_case_contains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(any_case_contains(F.col("p_name"), " WIDG_T ")).select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE p_name ILIKE '%rod%' OR p_type ILIKE '%rod%' OR p_brand ILIKE '%rod%' OR p_name ILIKE '%large%' OR p_type ILIKE '%large%' OR p_brand ILIKE '%large%'")
def r2_15_keyword_search(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(any_column_contains([F.col(c) for c in ("p_name", "p_type", "p_brand")], ["rod", "large", "rod"])).select("p_partkey")


@query("SELECT o_orderkey, false AS relaxed FROM orders WHERE year(o_orderdate) = 1996")
def r2_18_year_or_all(spark: SparkSession, d: str) -> DataFrame:
    return year_or_all(table(spark, d, "orders"), "o_orderdate", 1996).select("o_orderkey", "relaxed")


@query("""SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus NOT IN ('P') QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def r2_20_newest_not_in(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").filter(~F.col("o_orderstatus").isin("P"))
    return first_by(rows, ["o_custkey"], F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).select("o_custkey", "o_orderkey")


@query("SELECT DISTINCT p_type FROM part WHERE contains('compare LARGE with ECONOMY and SMALL', p_type) ORDER BY length(p_type) DESC, p_type LIMIT 16")
def r2_21_names_in_question(spark: SparkSession, d: str) -> DataFrame:
    return named_in("compare LARGE with ECONOMY and SMALL", table(spark, d, "part"), "p_type")


@query("""SELECT 'q1-src-' || row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS citation, o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def r2_25_citations(spark: SparkSession, d: str) -> DataFrame:
    top = table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25)
    n = F.row_number().over(Window.orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
    return top.select(F.concat(F.lit("q1-src-"), n.cast("string")).alias("citation"), "o_orderkey")


@query("""SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice::DECIMAL(18,2))::DOUBLE, 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1""")
def r3_02_three_way_join(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.filter("c_mktsegment = 'BUILDING'").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum(money("l_extendedprice")).cast("double"), 2).alias("total"))


@query("""SELECT n_name, c_custkey, s_suppkey FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 LEFT JOIN supplier ON s_nationkey = n_nationkey""")
def r3_03_fan_out_join(spark: SparkSession, d: str) -> DataFrame:
    """Customers of a nation with a balance over 9000, with all its suppliers: the rows grow with their product, and no task takes a whole nation."""
    c = table(spark, d, "customer").filter("c_acctbal > 9000")
    n = table(spark, d, "nation").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return dealt_left(n, table(spark, d, "supplier"), "n_nationkey", "s_nationkey").select("n_name", "c_custkey", "s_suppkey")


@query("""SELECT n_name, c_custkey, s_suppkey FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey""")
def r3_03_whole_fan_out_join(spark: SparkSession, d: str) -> DataFrame:
    """All customers of a nation, whatever their balance, with all its suppliers."""
    n = table(spark, d, "nation").join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return dealt_left(n, table(spark, d, "supplier"), "n_nationkey", "s_nationkey").select("n_name", "c_custkey", "s_suppkey")


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48) AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def r3_06_semi_joins_by_child(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem")
    out = table(spark, d, "orders")
    for condition in ("l_quantity > 48", "l_returnflag = 'R'"):
        out = out.join(items.filter(condition), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return out.select("o_orderkey")


@query("""SELECT e.event_id, e.event_type, c.c_mktsegment FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id WHERE e.event_type <> 'purchase' OR c.c_mktsegment = 'BUILDING'""")
def r3_08_outer_join_guard(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "events").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("user_id"), "left")
    return out.filter("event_type <> 'purchase' OR c_mktsegment = 'BUILDING'").select("event_id", "event_type", "c_mktsegment")


@query("""SELECT e.event_id FROM events e LEFT JOIN orders o ON o.o_orderkey = e.user_id WHERE o.o_orderkey IS NULL OR o.o_orderstatus = 'F'""")
def r3_11_drop_unavailable(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "events").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("user_id"), "left")
    return out.filter("o_orderkey IS NULL OR o_orderstatus = 'F'").select("event_id")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def r3_21_not_exists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def grouped(spark: SparkSession, d: str, *keys: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    return rows.groupBy(*keys).agg(F.count("*").alias("record_count"), F.round(F.sum(money("l_extendedprice")).cast("double"), 2).alias("total"))


@query("""SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS record_count, round(sum(l_extendedprice::DECIMAL(18,2))::DOUBLE, 2) AS total
FROM lineitem GROUP BY ALL ORDER BY total DESC, 1, 2, 3 LIMIT 10 OFFSET 5""")
def r4_06_multi_key_page(spark: SparkSession, d: str) -> DataFrame:
    keys = ("l_returnflag", "l_linestatus", "l_linenumber")
    return grouped(spark, d, *keys).orderBy(F.col("total").desc(), *keys).offset(5).limit(10)


@query("SELECT count(*) AS n_groups FROM (SELECT DISTINCT l_returnflag, l_suppkey FROM lineitem)")
def r4_08_count_of_groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_returnflag", "l_suppkey").distinct().agg(F.count("*").alias("n_groups"))


@query("""SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice::DECIMAL(18,2))::DOUBLE, 2) AS mean, count(DISTINCT o_custkey) AS customers FROM orders WHERE o_orderstatus = 'F'""")
def r4_09_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").filter("o_orderstatus = 'F'")
    mean = F.sum(money("o_totalprice")).cast("double") / F.count("o_totalprice")
    return rows.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.round(mean, 2).alias("mean"), F.count_distinct("o_custkey").alias("customers"))


@query("SELECT p_brand, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 10")
def r4_11_top_distribution(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter("p_brand is not null").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "p_brand").limit(10)


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def r4_13_children_per_node(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "customer").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0).cast("long")).alias("n_orders"))


@query("""SELECT flag, count(*) AS n FROM (SELECT 'large' AS flag FROM lineitem WHERE l_quantity > 40 UNION ALL SELECT 'returned' FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'discounted' FROM lineitem WHERE l_discount > 0.05) GROUP BY 1""")
def r4_14_flag_histogram(spark: SparkSession, d: str) -> DataFrame:
    flags = {"large": "l_quantity > 40", "returned": "l_returnflag = 'R'", "discounted": "l_discount > 0.05"}
    each = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(k)) for k, c in flags.items()]))
    return table(spark, d, "lineitem").select(F.explode(each).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query("""SELECT o_custkey, min(year(o_orderdate))::INT AS first_year, max(year(o_orderdate))::INT AS last_year, count(DISTINCT o_orderpriority) AS priorities, count(*) FILTER (o_totalprice > 300000) AS flagged,
CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS only_status FROM orders GROUP BY 1""")
def r4_15_recompute(spark: SparkSession, d: str) -> DataFrame:
    y = F.year("o_orderdate")
    return table(spark, d, "orders").groupBy("o_custkey").agg(
        F.min(y).alias("first_year"), F.max(y).alias("last_year"), F.count_distinct("o_orderpriority").alias("priorities"), F.count_if(F.col("o_totalprice") > 300000).alias("flagged"),
        F.when(F.min("o_orderstatus") == F.max("o_orderstatus"), F.min("o_orderstatus")).alias("only_status"),
    )


def rollup(active: Column, good: Column, bad: Column) -> Column:
    """open, processing, completed, failed or partial, from the states of a group's rows."""
    n = F.count("*")
    return F.when(n == 0, "open").when(F.count_if(active) > 0, "processing").when(F.count_if(good) == n, "completed").when(F.count_if(bad) == n, "failed").otherwise("partial")


@query("""SELECT l_orderkey, CASE WHEN count(*) FILTER (l_linestatus = 'O') > 0 THEN 'processing' WHEN count(*) FILTER (l_returnflag <> 'R') = count(*) THEN 'completed'
WHEN count(*) FILTER (l_returnflag = 'R') = count(*) THEN 'failed' ELSE 'partial' END AS status FROM lineitem GROUP BY 1""")
def r4_16_status_rollup(spark: SparkSession, d: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(rollup(F.col("l_linestatus") == "O", flag != "R", flag == "R").alias("status"))


@query("""SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'failed' WHEN bool_and(o_orderstatus = 'F') THEN 'indexed' ELSE min(o_orderstatus) END AS status FROM orders GROUP BY 1""")
def r4_20_index_status(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.when(F.bool_or(s == "P"), "failed").when(F.bool_and(s == "F"), "indexed").otherwise(F.min(s)).alias("status"))


@query("""SELECT c_mktsegment, count(*) AS total, count(*) FILTER (c_acctbal > 0) AS available, round(100.0 * count(*) FILTER (c_acctbal > 5000) / count(*), 1)::DOUBLE AS rich_percent FROM customer GROUP BY 1 ORDER BY 1""")
def r4_21_facets(spark: SparkSession, d: str) -> DataFrame:
    rich = F.round(100.0 * F.count_if(F.col("c_acctbal") > 5000) / F.count("*"), 1)
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("total"), F.count_if(F.col("c_acctbal") > 0).alias("available"), rich.alias("rich_percent")).orderBy("c_mktsegment")


@query("SELECT lang, round(quantile_cont(n_chars, 0.5))::BIGINT AS p50, round(quantile_cont(n_chars, 0.95))::BIGINT AS p95 FROM documents GROUP BY 1")
def r4_22_percentiles(spark: SparkSession, d: str) -> DataFrame:
    found = percentiles(table(spark, d, "documents").select("lang", "n_chars"), ["lang"], "n_chars", {"p50": 0.5, "p95": 0.95})
    return found.select("lang", *[F.round(p).cast("long").alias(p) for p in ("p50", "p95")])


@query("""WITH x AS (SELECT source, doc_id, text IS NOT NULL AND text LIKE '%.%' AS whole FROM documents)
SELECT source, round(avg(whole::INT), 4) AS coverage, CASE WHEN avg(whole::INT) >= 0.95 THEN 'pass' WHEN avg(whole::INT) >= 0.8 THEN 'warning' ELSE 'block' END AS verdict FROM x GROUP BY 1""")
def r4_23_coverage(spark: SparkSession, d: str) -> DataFrame:
    share = F.avg(F.coalesce(F.col("text").contains("."), F.lit(False)).cast("int"))
    return table(spark, d, "documents").groupBy("source").agg(F.round(share, 4).alias("coverage"), F.when(share >= 0.95, "pass").when(share >= 0.8, "warning").otherwise("block").alias("verdict"))


@query("""WITH x AS (SELECT d.source, (d.n_chars > 500)::INT AS said, l.quality AS truth FROM documents d JOIN labels l USING (doc_id)),
c AS (SELECT source, count(*) FILTER (said = 1 AND truth = 1) AS hit, count(*) FILTER (said = 1) AS n_said, count(*) FILTER (truth = 1) AS n_true FROM x GROUP BY 1)
SELECT source, round(CASE WHEN n_said = 0 THEN (n_true = 0)::INT ELSE hit / n_said END, 4)::DOUBLE AS p, round(CASE WHEN n_true = 0 THEN (n_said = 0)::INT ELSE hit / n_true END, 4)::DOUBLE AS r FROM c""")
def r4_24_precision_recall(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("source", (F.col("n_chars") > 500).alias("said"), (F.col("quality") == 1).alias("truth"))
    c = x.groupBy("source").agg(F.count_if(F.col("said") & F.col("truth")).alias("hit"), F.count_if("said").alias("n_said"), F.count_if("truth").alias("n_true"))
    share = lambda of, other: F.round(F.when(F.col(of) == 0, (F.col(other) == 0).cast("double")).otherwise(F.col("hit") / F.col(of)), 4)
    return c.select("source", share("n_said", "n_true").alias("p"), share("n_true", "n_said").alias("r"))

"""Record filters, lookups, projections and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltworks.functions import rules
from siltworks.operators.predicates import any_column_contains, matches
from siltworks.operators.windows import first_by
from siltworks.registry import query
from siltworks.sources.readers import fill_down, table

#: Endings of place names.
PLACE_ENDINGS = "(省|市|自治区|特别行政区)$"


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS filled FROM events""")
def r1_06_merged_cell_fill(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", fill_down(F.when(F.col("event_type") == "purchase", F.col("value")), "event_id", "user_id").alias("filled"))


@query("""SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag IN ('R', 'A') AND contains(o_orderpriority, 'HIGH') AND o_totalprice >= 100000""")
def r2_11_filters_of_both_sides(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    kept = matches(F.col("l_returnflag"), ["R", "A"]) & matches(F.col("o_orderpriority"), "HIGH", contains=True) & matches(F.col("o_totalprice"), {"gte": 100000})
    return rows.filter(kept).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey FROM part WHERE p_name ILIKE '%small%' OR p_type ILIKE '%small%' OR p_name ILIKE '%economy%' OR p_type ILIKE '%economy%'")
def r2_17_places(spark: SparkSession, d: str) -> DataFrame:
    import re

    wanted = [re.sub(PLACE_ENDINGS, "", x) for x in ("small市", "economy省")]
    return table(spark, d, "part").filter(any_column_contains([F.col("p_name"), F.col("p_type")], wanted)).select("p_partkey")


@query("""SELECT event_id FROM events WHERE contains(props, '"k": 8')""")
def r2_19_json_text_contains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter(F.col("props").contains('"k": 8')).select("event_id")


@query("""SELECT n_nationkey, CASE WHEN s_suppkey IS NOT NULL THEN to_json({'id': s_suppkey, 'name': s_name})::VARCHAR END AS supplier FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000""")
def r2_24_nested_projection(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").filter("s_acctbal > 5000")
    nested = F.when(F.col("s_suppkey").isNotNull(), F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))))
    return table(spark, d, "nation").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("n_nationkey", nested.alias("supplier"))


@query("""WITH x AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN 'row ' || event_id END AS cell FROM events)
SELECT event_id, TRY_CAST(cell AS BIGINT) AS row_start, TRY_CAST(cell AS BIGINT) AS row_end FROM x""")
def r2_26_row_ranges(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id").cast("string")
    cell = F.when(F.col("event_id") % 3 == 0, e).when(F.col("event_id") % 3 == 1, F.concat(F.lit("row "), e))
    n = cell.try_cast("long")
    return table(spark, d, "events").select("event_id", n.alias("row_start"), n.alias("row_end"))


@query("""SELECT l_orderkey, l_linenumber, c_name, s_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) ON s_suppkey = l_suppkey WHERE o_orderstatus = 'P'""")
def r3_04_inner_and_left_joins(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders").filter("o_orderstatus = 'P'"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier").filter("s_acctbal > 5000"), F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return rows.select("l_orderkey", "l_linenumber", "c_name", "s_name")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 10) OR l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 8000)""")
def r3_05_either_end(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").filter("p_size = 10").select("p_partkey").distinct()
    suppliers = table(spark, d, "supplier").filter("s_acctbal > 8000").select("s_suppkey").distinct()
    rows = table(spark, d, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"), "left").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return rows.filter("p_partkey IS NOT NULL OR s_suppkey IS NOT NULL").select("l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))""")
def r3_07_of_available_versions(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'")
    orders = table(spark, d, "orders").filter("o_orderstatus = 'F'").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber")


@query("""SELECT event_id, c_name, n_name, r_name FROM events LEFT JOIN customer ON c_custkey = user_id LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def r3_10_lookup_chain(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("user_id"), "left")
    rows = rows.join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return rows.select("event_id", "c_name", "n_name", "r_name")


METRICS = {
    "sum:price": lambda: F.coalesce(F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), 2), F.lit(0.0)),
    "max:price": lambda: F.coalesce(F.max("o_totalprice"), F.lit(0.0)),
    "count:record": lambda: F.count("*"),
}


@query("""SELECT nullif(o_orderstatus, 'P') AS status, round(sum(o_totalprice::DECIMAL(18,2))::DOUBLE, 2) AS "sum:price", max(o_totalprice) AS "max:price", count(*) AS "count:record" FROM orders GROUP BY 1""")
def r4_02_chosen_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The rows without a group stay as a group."""
    return table(spark, d, "orders").groupBy(F.nullif("o_orderstatus", F.lit("P")).alias("status")).agg(*[make().alias(name) for name, make in METRICS.items()])


@query("SELECT coalesce(sum(l_quantity) FILTER (l_quantity < 0), 0)::DOUBLE AS nothing, sum(l_quantity)::DOUBLE AS everything FROM lineitem")
def r4_10_coalesced_sum(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").agg(F.coalesce(F.sum(F.when(q < 0, q)), F.lit(0.0)).alias("nothing"), F.sum(q).alias("everything"))


@query("SELECT l_returnflag, count(DISTINCT l_orderkey) FILTER (l_quantity > 25) AS orders FROM lineitem GROUP BY 1")
def r4_12_filtered_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct(F.when(F.col("l_quantity") > 25, F.col("l_orderkey"))).alias("orders"))


@query("""WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT count(*) AS nodes, round(count(*) FILTER (n = 1) / count(*), 4)::DOUBLE AS single, round(count(*) FILTER (n > 1) / count(*), 4)::DOUBLE AS several, round(avg(n), 4)::DOUBLE AS mean FROM c""")
def r4_18_graph_stats(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    share = lambda c: F.round(F.count_if(c) / F.count("*"), 4)
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).agg(F.count("*").alias("nodes"), share(n == 1).alias("single"), share(n > 1).alias("several"), F.round(F.avg("n"), 4).alias("mean"))


@query("""SELECT CASE WHEN n_chars < 200 THEN '0-200' WHEN n_chars < 1000 THEN '200-1000' WHEN n_chars < 5000 THEN '1000-5000' ELSE '5000+' END AS size, count(*) AS n, max(n_chars) AS longest, round(avg(n_chars), 2)::DOUBLE AS mean FROM documents GROUP BY 1""")
def r4_19_unit_sizes(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    size = F.when(n < 200, "0-200").when(n < 1000, "200-1000").when(n < 5000, "1000-5000").otherwise("5000+")
    return table(spark, d, "documents").groupBy(size.alias("size")).agg(F.count("*").alias("n"), F.max(n).alias("longest"), F.round(F.avg(n), 2).alias("mean"))


@query("SELECT user_id, event_type, min(event_id) AS event_id, count(*) - 1 AS dropped FROM events GROUP BY ALL")
def r5_05_first_seen_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"), (F.count("*") - 1).alias("dropped"))


@query("""WITH x AS (SELECT conv_id, turn, turn - 2 * row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM conversations WHERE role = 'user')
SELECT conv_id, min(turn) AS first, count(*) AS length FROM x GROUP BY conv_id, run""")
def r5_11_runs_of_turns(spark: SparkSession, d: str) -> DataFrame:
    """Runs in which every second turn is the user's."""
    x = table(spark, d, "conversations").filter("role = 'user'")
    run = F.col("turn") - 2 * F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return x.withColumn("run", run).groupBy("conv_id", "run").agg(F.min("turn").alias("first"), F.count("*").alias("length")).drop("run")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def r5_14_cap_per_source(spark: SparkSession, d: str) -> DataFrame:
    """At most three a customer, the dearest; Spark trims groups before their shuffle."""
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
    return table(spark, d, "orders").withColumn("rank", rank).filter("rank <= 3").select("o_custkey", "o_orderkey")


@query("""WITH x AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages) SELECT u AS url, min(page_id) AS page_id, count(*) - 1 AS removed FROM x GROUP BY 1""")
def r7_06_url_dedupe(spark: SparkSession, d: str) -> DataFrame:
    u = F.regexp_replace("url", r"[?#].*$", "")
    return table(spark, d, "pages").groupBy(u.alias("url")).agg(F.min("page_id").alias("page_id"), (F.count("*") - 1).alias("removed"))


@query("""WITH x AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS admitted, count(*) AS n, min(o_totalprice) AS least FROM orders GROUP BY 1)
SELECT o_custkey, admitted = n AND least > 50000 AS admitted FROM x""")
def r12_05_admission(spark: SparkSession, d: str) -> DataFrame:
    ok = F.bool_and(F.col("o_orderstatus") == "F") & (F.min("o_totalprice") > 50000)
    return table(spark, d, "orders").groupBy("o_custkey").agg(ok.alias("admitted"))


@query("""SELECT o_orderkey, c_custkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE CASE WHEN nullif(o_orderpriority, '5-LOW') IS NOT NULL THEN nullif(o_orderpriority, '5-LOW') <> '1-URGENT' ELSE o_orderstatus <> 'F' END""")
def r12_11_recompute_targets(spark: SparkSession, d: str) -> DataFrame:
    """Rows of another rules version; where it is missing, of another schema version."""
    rules_version = F.nullif("o_orderpriority", F.lit("5-LOW"))
    stale = F.when(rules_version.isNotNull(), rules_version != "1-URGENT").otherwise(F.col("o_orderstatus") != "F")
    return table(spark, d, "orders").filter(stale).join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_custkey")


@query("""SELECT 'small_part' AS rule, p_partkey AS id FROM part WHERE p_size < 3 UNION ALL SELECT 'unused_part', p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)
UNION ALL SELECT 'same_name', p_partkey FROM (SELECT p_partkey, count(*) OVER (PARTITION BY p_name, p_brand, p_type) AS n FROM part) WHERE n > 1 UNION ALL SELECT 'bad_code', p_partkey FROM part WHERE NOT regexp_full_match(p_brand, 'Brand#[1-4][0-9]')""")
def r12_07_quality_findings(spark: SparkSession, d: str) -> DataFrame:
    """One table of findings, a query for each rule."""
    part = table(spark, d, "part")
    copies = F.count("*").over(Window.partitionBy("p_name", "p_brand", "p_type"))
    found = {
        "small_part": part.filter("p_size < 3"),
        "unused_part": part.join(table(spark, d, "lineitem"), F.col("p_partkey") == F.col("l_partkey"), "left_anti"),
        "same_name": part.withColumn("n", copies).filter("n > 1"),
        "bad_code": part.filter(~F.col("p_brand").rlike("^Brand#[1-4][0-9]$")),
    }
    parts = [rows.select(F.lit(rule).alias("rule"), F.col("p_partkey").alias("id")) for rule, rows in found.items()]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


@query("""WITH x AS (SELECT p_partkey, p_brand, CASE WHEN p_size IS NULL THEN 'missing_content' WHEN p_type NOT IN ('ECONOMY', 'SMALL', 'LARGE', 'STANDARD') THEN 'unknown_category' END AS first_reason,
row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) SELECT p_partkey, coalesce(first_reason, CASE WHEN n > 1 THEN 'duplicate_code' END) AS rejected FROM x""")
def r15_01_row_admission(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    firsts = part.groupBy("p_brand").agg(F.min("p_partkey").alias("first"))
    known = F.col("p_type").isin("ECONOMY", "SMALL", "LARGE", "STANDARD")
    why = rules.first_reason(("missing_content", F.col("p_size").isNull()), ("unknown_category", ~known), ("duplicate_code", F.col("p_partkey") > F.col("first")))
    return part.join(firsts, "p_brand").select("p_partkey", why.alias("rejected"))


@query("""SELECT lower(regexp_replace(p_name, '\\s+', '', 'g')) AS name, p_type, array_to_string(list_sort(list(DISTINCT p_brand)), ';') AS brands, count(*) AS n FROM part GROUP BY 1, 2""")
def r15_15_merged_fragments(spark: SparkSession, d: str) -> DataFrame:
    name = F.lower(F.regexp_replace("p_name", r"\s+", ""))
    return table(spark, d, "part").groupBy(name.alias("name"), "p_type").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ";").alias("brands"), F.count("*").alias("n"))


@query("""SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus <> 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY nullif(o_orderdate, TIMESTAMP '1997-01-15') DESC NULLS LAST, o_orderkey) = 1""")
def r15_26_newest_reusable(spark: SparkSession, d: str) -> DataFrame:
    done = F.nullif("o_orderdate", F.lit("1997-01-15").cast("timestamp_ntz"))
    return first_by(table(spark, d, "orders").filter("o_orderstatus <> 'F'"), ["o_custkey"], done.desc_nulls_last(), F.col("o_orderkey").asc()).select("o_custkey", "o_orderkey")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, '# ' || o_custkey || chr(10) || string_agg('- ' || o_orderkey, chr(10) ORDER BY o_orderkey) || CASE WHEN any_value(n) > 5 THEN chr(10) || '(' || (any_value(n) - 5) || ' more)' ELSE '' END AS markdown FROM r WHERE k <= 5 GROUP BY 1""")
def r15_20_records_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    """A heading, the first five records, and how many are left out."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    lines = orders.withColumn("k", k).filter("k <= 5").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    n = orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    listed = F.array_join(F.transform("ids", lambda i: F.concat(F.lit("- "), i.cast("string"))), "\n")
    more = F.when(F.col("n") > 5, F.concat(F.lit("\n("), (F.col("n") - 5).cast("string"), F.lit(" more)"))).otherwise("")
    return lines.join(n, "o_custkey").select("o_custkey", F.concat(F.lit("# "), F.col("o_custkey").cast("string"), F.lit("\n"), listed, more).alias("markdown"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'auto' WHEN o_orderstatus = 'P' THEN 'review' ELSE 'manual' END AS mode FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def r15_34_trace_page(spark: SparkSession, d: str) -> DataFrame:
    mode = F.when(F.col("o_orderpriority").startswith("1"), "auto").when(F.col("o_orderstatus") == "P", "review").otherwise("manual")
    return table(spark, d, "orders").orderBy(F.col("o_orderdate").desc(), "o_orderkey").offset(100).limit(50).select("o_orderkey", mode.alias("mode"))

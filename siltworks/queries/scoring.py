"""Tag rows, coercion, gates and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions import rules
from siltworks.registry import query
from siltworks.sources.readers import table


@query("SELECT p_partkey, concat_ws('.', lower(p_type), p_brand, 'v' || p_size) AS key FROM part")
def r8_06_collection_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.concat_ws(".", F.lower("p_type"), "p_brand", F.concat(F.lit("v"), F.col("p_size").cast("string"))).alias("key"))


@query("SELECT event_id, coalesce(nullif(trim(CASE WHEN event_id % 2 = 0 THEN ' ' END), ''), nullif(trim(CASE WHEN event_id % 3 = 0 THEN event_type END), ''), 'generic') AS domain FROM events")
def r8_07_domain_type(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", rules.first_filled(F.when(e % 2 == 0, " "), F.when(e % 3 == 0, F.col("event_type")), default="generic").alias("domain"))


@query("""SELECT p_partkey, CASE WHEN p_type = q THEN 'L1' ELSE 'L1.5' END AS layer, 1.0::DOUBLE AS score FROM part JOIN (VALUES ('ECONOMY'), ('small')) t(q) ON lower(p_type) = lower(trim(q))""")
def r8_08_exact_tags(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.createDataFrame([("ECONOMY",), ("small",)], "q string")
    rows = table(spark, d, "part").join(F.broadcast(wanted), F.lower("p_type") == F.lower(F.trim("q")))
    return rows.select("p_partkey", F.when(F.col("p_type") == F.col("q"), "L1").otherwise("L1.5").alias("layer"), F.lit(1.0).alias("score"))


@query("""WITH a AS (SELECT * FROM (VALUES ('cheap', 'ECONOMY'), ('big', 'LARGE'), ('LARGE', 'LARGE')) t(alias, canonical)), q AS (SELECT * FROM (VALUES ('cheap'), ('LARGE')) t(v))
SELECT p_partkey, p_type FROM part WHERE p_type IN (SELECT canonical FROM a JOIN q ON alias = v WHERE canonical NOT IN (SELECT v FROM q))""")
def r8_09_aliased_tags(spark: SparkSession, d: str) -> DataFrame:
    """Canonical values of aliases, less the values asked for themselves."""
    aliases = spark.createDataFrame([("cheap", "ECONOMY"), ("big", "LARGE"), ("LARGE", "LARGE")], "alias string, canonical string")
    asked = spark.createDataFrame([("cheap",), ("LARGE",)], "v string")
    found = aliases.join(asked, F.col("alias") == F.col("v")).select("canonical").join(asked, F.col("canonical") == F.col("v"), "left_anti")
    return table(spark, d, "part").join(F.broadcast(found), F.col("p_type") == F.col("canonical"), "left_semi").select("p_partkey", "p_type")


@query("""SELECT p_partkey, 'type' AS tag_type, trim(p_type) AS tag_value FROM part WHERE trim(p_type) <> '' UNION ALL SELECT p_partkey, 'brand', trim(p_brand) FROM part WHERE trim(p_brand) <> '' UNION ALL SELECT p_partkey, 'size', p_size::VARCHAR FROM part WHERE p_size IS NOT NULL""")
def r8_17_tags_of_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = rules.tag_rows({"type": F.col("p_type"), "brand": F.col("p_brand"), "size": F.col("p_size")})
    return table(spark, d, "part").select("p_partkey", F.inline(rows))


@query("""SELECT p_partkey, 'family' AS tag_type, coalesce(nullif(trim(CASE WHEN p_size > 40 THEN p_brand END), ''), nullif(trim(p_type), '')) AS tag_value FROM part WHERE p_size > 25 AND coalesce(nullif(trim(p_brand), ''), p_type) IS NOT NULL""")
def r8_18_conditional_tags(spark: SparkSession, d: str) -> DataFrame:
    value = rules.first_filled(F.when(F.col("p_size") > 40, F.col("p_brand")), F.col("p_type"))
    return table(spark, d, "part").filter("p_size > 25").select("p_partkey", F.inline(rules.tag_rows({"family": value})))


@query("SELECT event_id, json_extract_string(props, '$.k') AS tag_value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def r8_19_tags_of_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("tag_value")).filter("tag_value IS NOT NULL")


@query("SELECT event_id, CASE WHEN TRY_CAST(v AS INT) BETWEEN 1900 AND 2100 THEN TRY_CAST(v AS INT) END AS year FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN (1850 + event_id % 300)::VARCHAR WHEN 1 THEN 'no year' END AS v FROM events)")
def r8_22_years(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    v = F.when(e % 3 == 0, (1850 + e % 300).cast("string")).when(e % 3 == 1, "no year")
    return table(spark, d, "events").select("event_id", rules.plausible_year(v).alias("year"))


@query("SELECT user_id, max(value) FILTER (event_type = 'purchase') AS confidence FROM events GROUP BY 1")
def r8_28_answer_confidence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("confidence"))


@query("""SELECT c_custkey, regexp_matches(c_name, '^[^A-Za-z]*$') AS pure_index, regexp_full_match(right(c_name, 6), '[0-9]{6}') AS is_code, TRY_CAST(trim(' ' || c_acctbal || ' ') AS DOUBLE) AS amount,
CASE WHEN trim(c_name) <> '' AND trim(c_mktsegment) <> '' THEN trim(c_name) || '|' || trim(c_mktsegment) END AS key FROM customer""")
def r9_03_keys_and_codes(spark: SparkSession, d: str) -> DataFrame:
    name, segment = F.trim("c_name"), F.trim("c_mktsegment")
    amount = F.trim(F.concat(F.lit(" "), F.col("c_acctbal").cast("string"), F.lit(" "))).try_cast("double")
    return table(spark, d, "customer").select(
        "c_custkey", F.col("c_name").rlike("^[^A-Za-z]*$").alias("pure_index"), F.substring("c_name", -6, 6).rlike("^[0-9]{6}$").alias("is_code"), amount.alias("amount"),
        F.when((name != "") & (segment != ""), F.concat(name, F.lit("|"), segment)).alias("key"),
    )


@query("""WITH x AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN 'soon' END AS t, o_orderdate FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN epoch(o_orderdate)::BIGINT END AS seconds, coalesce(t = 'soon', false) AS failed FROM x""")
def r9_12_parsed_times(spark: SparkSession, d: str) -> DataFrame:
    k, o = F.col("o_orderkey") % 4, F.col("o_orderdate")
    t = F.when(k == 0, F.date_format(o, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format(o, "yyyy-MM-dd")).when(k == 2, "soon")
    made, failed = rules.to_timestamp_utc(t)
    return table(spark, d, "orders").select("o_orderkey", F.unix_timestamp(made).alias("seconds"), failed.alias("failed"))


@query("""SELECT page_id, CASE WHEN n > 0 THEN round(m / n, 4) ELSE 0 END::DOUBLE AS share FROM (SELECT page_id, length(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '\\s+', '', 'g')) AS n,
coalesce(list_sum(list_transform(regexp_extract_all(html, '(?is)<a\\b[^>]*>(.*?)</a>', 1), lambda t: length(regexp_replace(regexp_replace(t, '<[^>]*>', '', 'g'), '\\s+', '', 'g')))), 0) AS m FROM pages)""")
def r9_24_link_share(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", rules.link_share(F.col("html")).alias("share"))


@query("""SELECT event_id, round(value)::BIGINT || ' 000%' AS raw, round(value)::BIGINT || '000%' AS plain FROM events""")
def r9_32_plain_literals(spark: SparkSession, d: str) -> DataFrame:
    n = F.round("value").cast("long").cast("string")
    x = table(spark, d, "events").select("event_id", F.concat(n, F.lit(" 000%")).alias("raw"), F.concat(F.lit(" "), n, F.lit(" 000 ％")).alias("wide"))
    return x.select("event_id", "raw", rules.plain_literal(F.col("wide")).alias("plain"))


@query("""SELECT l_orderkey, l_linenumber, sha256('{"object":"' || l_suppkey || '","predicate":"supplied_by","subject":"' || l_partkey || '"}') AS fact FROM lineitem""")
def r9_33_fact_keys(spark: SparkSession, d: str) -> DataFrame:
    """SHA-256 of the fact as JSON with sorted fields."""
    fact = F.to_json(F.struct(F.col("l_suppkey").cast("string").alias("object"), F.lit("supplied_by").alias("predicate"), F.col("l_partkey").cast("string").alias("subject")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.sha2(fact, 256).alias("fact"))


@query("""WITH x AS (SELECT p_partkey, p_size % 3 + 1 AS k, '第' || p_partkey || '章 ' || p_name || ' ...... ' || p_size AS line FROM part)
SELECT p_partkey, regexp_extract(line, '^第([0-9]+)章', 1)::BIGINT AS number, regexp_extract(line, '^第[0-9]+章 (.*?) *\\.{3,} *[0-9]+$', 1) AS title, regexp_extract(line, '([0-9]+)$', 1)::BIGINT AS page FROM x""")
def r10_05_contents_lines(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("第"), F.col("p_partkey").cast("string"), F.lit("章 "), F.col("p_name"), F.lit(" ...... "), F.col("p_size").cast("string"))
    part = lambda k: F.regexp_extract(line, r"^第([0-9]+)章 (.*?) *\.{3,} *([0-9]+)$", k)
    return table(spark, d, "part").select("p_partkey", part(1).cast("long").alias("number"), part(2).alias("title"), part(3).cast("long").alias("page"))


@query("""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(text, '([A-Za-z])-\\r?\\n\\s*([a-z])', '\\1\\2', 'g'), '\\s*\\r?\\n\\s*', ' ', 'g'), ' ')) AS joined FROM documents""")
def r10_07_joined_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(rules.join_lines(F.col("text")), 256).alias("joined"))


@query("""SELECT page_id, CASE WHEN NOT starts_with(url, 'https:') THEN 'unsafe_url' WHEN regexp_matches(url, '^[a-z]+://[^/]+/?$') THEN 'homepage_or_channel' WHEN contains(url, '/news/') THEN 'news_report' WHEN length(html) < 800 THEN 'too_short' END AS reason FROM pages""")
def r10_40_web_gate(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    why = rules.first_reason(("unsafe_url", ~u.startswith("https:")), ("homepage_or_channel", u.rlike("^[a-z]+://[^/]+/?$")), ("news_report", u.contains("/news/")), ("too_short", F.length("html") < 800))
    return table(spark, d, "pages").select("page_id", why.alias("reason"))


@query("""SELECT l_partkey, l_suppkey, count(*) AS evidence, min(l_orderkey) AS first_seen, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS flags FROM lineitem GROUP BY 1, 2""")
def r11_12_merged_facts(spark: SparkSession, d: str) -> DataFrame:
    flags = F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",")
    return table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("evidence"), F.min("l_orderkey").alias("first_seen"), flags.alias("flags"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice < 60000 OR NOT o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'review' ELSE 'adopted' END AS classification, CASE WHEN o_totalprice < 30000 THEN 'review' ELSE 'adopted' END AS tags,
array_to_string(list_filter([CASE WHEN o_orderstatus = 'P' THEN 'partial' END, CASE WHEN o_totalprice < 90000 THEN 'below_floor' END], lambda x: x IS NOT NULL), ',') AS reasons FROM orders""")
def r12_03_decisions(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("o_totalprice")
    review = lambda c: F.when(c, "review").otherwise("adopted")
    known = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM")
    reasons = rules.all_reasons(("partial", F.col("o_orderstatus") == "P"), ("below_floor", price < 90000))
    return table(spark, d, "orders").select("o_orderkey", review((price < 60000) | ~known).alias("classification"), review(price < 30000).alias("tags"), F.array_join(reasons, ",").alias("reasons"))


@query("""SELECT event_id, left(event_type, 4) AS item_type, CASE WHEN value / 100 BETWEEN 0 AND 1 THEN (value / 100)::DECIMAL(5,4)::DOUBLE END AS confidence, CASE WHEN event_type ILIKE '%purchase%' THEN 0.75 ELSE 0.3 END::DOUBLE AS emitted FROM events WHERE event_type IN ('purchase', 'signup', 'error')""")
def r12_09_normal_items(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("value") / 100
    rows = table(spark, d, "events").filter(F.col("event_type").isin("purchase", "signup", "error"))
    return rows.select("event_id", F.substring("event_type", 1, 4).alias("item_type"), F.when(c.between(0, 1), c.cast("decimal(5,4)").cast("double")).alias("confidence"), F.when(F.col("event_type").ilike("%purchase%"), 0.75).otherwise(0.3).alias("emitted"))


@query("""WITH x AS (SELECT c_nationkey, CASE WHEN c_acctbal >= 7000 THEN 'high' WHEN c_acctbal >= 2000 THEN 'mid' ELSE 'low' END AS level FROM customer)
SELECT c_nationkey, count(*) FILTER (level = 'high') AS high, count(*) FILTER (level = 'mid') AS mid, count(*) FILTER (level = 'low') AS low, count(*) FILTER (level = 'high') >= 0.4 * count(*) AND count(*) FILTER (level = 'low') = 0 AS auto FROM x GROUP BY 1""")
def r15_05_confidence_gate(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each level, and whether a group is adopted without review (r15_06)."""
    n = lambda level: F.count_if(F.col("level") == level)
    x = table(spark, d, "customer").select("c_nationkey", rules.confidence_level(F.col("c_acctbal"), 7000, 2000).alias("level"))
    return x.groupBy("c_nationkey").agg(n("high").alias("high"), n("mid").alias("mid"), n("low").alias("low"), ((n("high") >= 0.4 * F.count("*")) & (n("low") == 0)).alias("auto"))


@query("""SELECT source, count(*) AS nodes, round(count(*) FILTER (text LIKE '%.%') / count(*), 4)::DOUBLE AS located, count(*) FILTER (text LIKE '%.%') / count(*) < 0.95 AS review FROM documents GROUP BY 1""")
def r15_09_outline_quality(spark: SparkSession, d: str) -> DataFrame:
    share = F.count_if(F.col("text").contains(".")) / F.count("*")
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("nodes"), F.round(share, 4).alias("located"), (share < 0.95).alias("review"))


@query("""WITH x AS (SELECT p_partkey, p_name || ' (' || p_size || '学时)' AS course FROM part) SELECT regexp_replace(course, ' *\\([0-9]+学时\\)$', '') AS name, min(p_partkey) AS first FROM x GROUP BY 1""")
def r15_14_course_names(spark: SparkSession, d: str) -> DataFrame:
    course = F.concat("p_name", F.lit(" ("), F.col("p_size").cast("string"), F.lit("学时)"))
    return table(spark, d, "part").groupBy(F.regexp_replace(course, r" *\([0-9]+学时\)$", "").alias("name")).agg(F.min("p_partkey").alias("first"))


@query("""SELECT p_partkey, array_to_string(list_filter([p_type, CASE WHEN p_brand <> p_type THEN p_brand END, CASE WHEN upper(p_name) NOT IN (p_type, p_brand) THEN upper(p_name) END], lambda x: x IS NOT NULL), '|') AS tags FROM part""")
def r15_17_flat_payload(spark: SparkSession, d: str) -> DataFrame:
    """Values of all buckets in the order of the buckets, each where it comes first."""
    flat = F.array_distinct(F.flatten(F.array(F.array("p_type"), F.array("p_brand", F.upper("p_name")))))
    return table(spark, d, "part").select("p_partkey", F.array_join(flat, "|").alias("tags"))

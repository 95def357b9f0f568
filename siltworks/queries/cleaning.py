"""Coercion, fingerprints, gates and document operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltworks.functions import clean
from siltworks.operators.trees import overlaps
from siltworks.registry import query
from siltworks.sources.readers import table


@query("SELECT c_custkey, sha256(lower(trim(coalesce(c_name, ''))) || '|' || lower(trim(coalesce(c_mktsegment, ''))) || '|' || coalesce(c_nationkey::VARCHAR, '')) AS fp FROM customer")
def r9_02_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", clean.fingerprint(F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey")).alias("fp"))


@query("""WITH x AS (SELECT event_id, event_id % 7 AS k FROM events), v AS (SELECT event_id, CASE k WHEN 0 THEN ' N/A ' WHEN 1 THEN '' WHEN 2 THEN '无' WHEN 3 THEN '5.9' WHEN 4 THEN '-3 people' WHEN 5 THEN 'around 12' ELSE NULL END AS cell FROM x)
SELECT event_id, coalesce(lower(trim(cell)) IN ('……', '...', '—', '-', '无', 'n/a', 'na', 'null', 'none'), false) AS placeholder, coalesce(trim(cell), '') = '' AS blank,
trunc(TRY_CAST(trim(cell) AS DOUBLE))::BIGINT AS whole, TRY_CAST(nullif(regexp_extract(cell, '-?[0-9]+'), '') AS BIGINT) AS found FROM v""")
def r9_06_placeholders_and_numbers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 7
    cell = F.when(k == 0, " N/A ").when(k == 1, "").when(k == 2, "无").when(k == 3, "5.9").when(k == 4, "-3 people").when(k == 5, "around 12")
    v = table(spark, d, "events").select("event_id", cell.alias("cell"))
    c = F.col("cell")
    return v.select("event_id", clean.is_placeholder(c).alias("placeholder"), clean.is_blank(c).alias("blank"), clean.to_int(c).alias("whole"), clean.int_in(c).alias("found"))


@query("""SELECT c_custkey, CASE WHEN coalesce(trim(c_name), '') = '' AND c_acctbal IS NULL THEN 'empty_row' WHEN lower(trim(c_mktsegment)) IN ('-', 'na') THEN 'placeholder_text'
WHEN NOT regexp_matches(c_name, '[A-Za-z]') THEN 'pure_index' WHEN contains(c_name, '000000001') THEN 'example_row' WHEN c_acctbal < 0 THEN 'missing_required_field' ELSE 'data' END AS kind FROM customer""")
def r9_07_row_classes(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("c_name")
    kind = (
        F.when(clean.is_blank(name) & F.col("c_acctbal").isNull(), "empty_row")
        .when(clean.is_placeholder(F.col("c_mktsegment")), "placeholder_text")
        .when(~name.rlike("[A-Za-z]"), "pure_index")
        .when(name.contains("000000001"), "example_row")
        .when(F.col("c_acctbal") < 0, "missing_required_field")
        .otherwise("data")
    )
    return table(spark, d, "customer").select("c_custkey", kind.alias("kind"))


@query("""WITH x AS (SELECT o_orderkey, 'of ' || year(o_orderdate) || '-' || month(o_orderdate) || '/' || day(o_orderdate) AS t FROM orders)
SELECT o_orderkey, TRY_CAST(nullif(regexp_extract(t, '(?:19|20)[0-9]{2}'), '') AS INT) AS year,
CASE WHEN regexp_matches(t, '20[0-9]{2}[年\\-/.][0-9]{1,2}[月\\-/.][0-9]{1,2}') THEN regexp_extract(t, '(20[0-9]{2})', 1) || '-' || lpad(regexp_extract(t, '20[0-9]{2}[年\\-/.]([0-9]{1,2})', 1), 2, '0') || '-' || lpad(regexp_extract(t, '[月\\-/.][0-9]{1,2}[月\\-/.]([0-9]{1,2})', 1), 2, '0') END AS date FROM x""")
def r9_14_dates_in_text(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o_orderdate")
    t = F.concat(F.lit("of "), F.year(o).cast("string"), F.lit("-"), F.month(o).cast("string"), F.lit("/"), F.day(o).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", t.alias("t")).select("o_orderkey", clean.year_in(F.col("t")).alias("year"), clean.date_in(F.col("t")).alias("date"))


@query("""WITH x AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u, url FROM pages),
y AS (SELECT page_id, url, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) AS head, regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', '') AS path FROM x)
SELECT page_id, regexp_replace(regexp_replace(head, '^(http://.*):80$', '\\1'), '^(https://.*):443$', '\\1') || CASE WHEN path LIKE '/%' THEN path ELSE '/' || path END AS normal,
lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host, url LIKE 'https:%' AS safe FROM y""")
def r9_16_urls(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", clean.normal_url(u).alias("normal"), clean.host(u).alias("host"), clean.url_is_safe(u).alias("safe"))


@query("""SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))) AS n_chars,
sha256(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))) AS body FROM pages""")
def r9_20_stripped_pages(spark: SparkSession, d: str) -> DataFrame:
    text = clean.strip_tags(F.col("html"))
    return table(spark, d, "pages").select("page_id", text.alias("t")).select("page_id", F.length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("body"))


@query("""WITH x AS (SELECT doc_id, 'sk-abc_' || doc_id || ' Bearer  tok.' || doc_id || ' ' || text AS t FROM documents)
SELECT doc_id, sha256(regexp_replace(regexp_replace(left(t, 2000), 'sk-[A-Za-z0-9_-]+', 'sk-***', 'g'), 'Bearer +[A-Za-z0-9._-]+', 'Bearer ***', 'g')) AS masked FROM x""")
def r9_21_masked_secrets(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("sk-abc_"), F.col("doc_id").cast("string"), F.lit(" Bearer  tok."), F.col("doc_id").cast("string"), F.lit(" "), "text")
    return table(spark, d, "documents").select("doc_id", F.sha2(clean.mask_secrets(t), 256).alias("masked"))


@query("""SELECT c_custkey, CASE WHEN s >= 80 THEN 'pass' WHEN s >= 50 THEN 'warning' ELSE 'fail' END AS level, s AS score
FROM (SELECT c_custkey, round((0.6 * least(greatest(c_acctbal, 0) / 100, 100) + 0.4 * (c_nationkey * 4))::DOUBLE, 2) AS s FROM customer)""")
def r9_26_weighted_score(spark: SparkSession, d: str) -> DataFrame:
    s = F.round(0.6 * F.least(F.greatest("c_acctbal", F.lit(0)) / 100, F.lit(100.0)) + 0.4 * (F.col("c_nationkey") * 4), 2)
    x = table(spark, d, "customer").select("c_custkey", s.alias("score"))
    return x.withColumn("level", F.when(F.col("score") >= 80, "pass").when(F.col("score") >= 50, "warning").otherwise("fail"))


@query("""SELECT conv_id, min(turn) AS first, max(turn) AS last, CASE WHEN count(DISTINCT role) = 1 THEN min(role) END AS only_role FROM conversations GROUP BY 1""")
def r9_35_envelope(spark: SparkSession, d: str) -> DataFrame:
    only = F.when(F.min("role") == F.max("role"), F.min("role"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.min("turn").alias("first"), F.max("turn").alias("last"), only.alias("only_role"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS n FROM l WHERE NOT (regexp_matches(trim(line), '^#') OR length(trim(line)) < 4 OR regexp_matches(trim(line), '^[-0-9 .]+$')) GROUP BY 1""")
def r10_09_meaningful_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are no headings, page numbers or scraps."""
    line = F.trim("line")
    rows = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return rows.filter(~(line.startswith("#") | (F.length(line) < 4) | line.rlike(r"^[-0-9 .]+$"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("""SELECT doc_id FROM documents WHERE contains(lower(text), 'license')::INT + contains(lower(text), 'copyright')::INT + contains(lower(text), 'rights reserved')::INT + contains(lower(text), 'permission')::INT >= 2""")
def r10_12_publication_noise(spark: SparkSession, d: str) -> DataFrame:
    marks = [F.lower("text").contains(w).cast("int") for w in ("license", "copyright", "rights reserved", "permission")]
    return table(spark, d, "documents").filter(reduce(lambda a, b: a + b, marks) >= 2).select("doc_id")


@query("""SELECT c_custkey, sha256('## ' || c_name || chr(10) || 'segment: ' || coalesce(c_mktsegment, '') || chr(10) || 'nation: ' || coalesce(c_nationkey::VARCHAR, '')) AS chunk FROM customer""")
def r10_20_row_chunks(spark: SparkSession, d: str) -> DataFrame:
    part = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(F.col(c).cast("string"), F.lit("")))
    chunk = F.concat_ws("\n", F.concat(F.lit("## "), "c_name"), part("segment", "c_mktsegment"), part("nation", "c_nationkey"))
    return table(spark, d, "customer").select("c_custkey", F.sha2(chunk, 256).alias("chunk"))


@query("""SELECT conv_id, turn, next_turn, q_chars, a_chars FROM (SELECT conv_id, turn, role, length(text) AS q_chars, lead(role) OVER w AS next_role, lead(turn) OVER w AS next_turn, length(lead(text) OVER w) AS a_chars
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)) WHERE role = 'user' AND next_role = 'assistant' AND q_chars >= 10 AND a_chars >= 10""")
def r10_21_question_answer_pairs(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    next_ = lambda c: F.lead(c).over(w)
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("q_chars"), next_("role").alias("next_role"), next_("turn").alias("next_turn"), F.length(next_("text")).cast("long").alias("a_chars"))
    return rows.filter("role = 'user' AND next_role = 'assistant' AND q_chars >= 10 AND a_chars >= 10").select("conv_id", "turn", "next_turn", "q_chars", "a_chars")


@query("""SELECT page_id, CASE WHEN NOT url LIKE 'https:%' THEN 'unsafe_url' WHEN length(html) < 800 THEN 'too_short' WHEN contains(lower(html), 'captcha') OR contains(lower(html), 'login') THEN 'login_or_captcha' ELSE 'pass' END AS verdict FROM pages""")
def r10_41_page_gate(spark: SparkSession, d: str) -> DataFrame:
    html = F.lower("html")
    verdict = F.when(~clean.url_is_safe(F.col("url")), "unsafe_url").when(F.length("html") < 800, "too_short").when(html.contains("captcha") | html.contains("login"), "login_or_captcha").otherwise("pass")
    return table(spark, d, "pages").select("page_id", verdict.alias("verdict"))


@query("""WITH b AS (SELECT conv_id, turn, turn * 100 AS b_start, turn * 100 + length(text) AS b_end FROM conversations), s AS (SELECT conv_id, turn AS s_turn, turn * 100 + 50 AS s_start, turn * 100 + 250 AS s_end FROM conversations WHERE role = 'user')
SELECT conv_id, turn, s_turn FROM b JOIN s USING (conv_id) WHERE b_start < s_end AND b_end > s_start""")
def r3_12_span_overlap(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").filter("text is not null and turn is not null")
    b = rows.select("conv_id", "turn", (F.col("turn") * 100).alias("b_start"), (F.col("turn") * 100 + F.length("text")).alias("b_end"))
    s = rows.filter("role = 'user'").select("conv_id", F.col("turn").alias("s_turn"), (F.col("turn") * 100 + 50).alias("s_start"), (F.col("turn") * 100 + 250).alias("s_end"))
    return overlaps(b, s, "conv_id", 400).select("conv_id", "turn", "s_turn")


@query("""SELECT p_partkey, CASE WHEN contains(p_name, 'large rod') OR contains('large rod', p_name) THEN 1.0::DOUBLE ELSE round(0.7 * shared / nq + 0.3 * shared / nt, 6)::DOUBLE END AS score FROM (
SELECT p_partkey, p_name, len(list_intersect(q, t)) AS shared, len(q) AS nq, len(t) AS nt FROM (
SELECT p_partkey, p_name, list_distinct(list_transform(generate_series(1, length('large rod') - 1), lambda i: substring('large rod', i::INT, 2))) AS q, list_distinct(list_transform(generate_series(1, length(p_name) - 1), lambda i: substring(p_name, i::INT, 2))) AS t FROM part))""")
def r8_26_title_relevance(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.round(clean.title_relevance(F.lit("large rod"), F.col("p_name")), 6).alias("score"))

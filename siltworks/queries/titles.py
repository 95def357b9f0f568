"""Titles against queries over titles of pages and headings of documents, with the rule in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions import titles
from siltworks.operators import sections
from siltworks.queries.lines import SPLIT, split_lines
from siltworks.registry import query
from siltworks.sources.readers import table

_qk = lambda x: f"lower(regexp_replace(coalesce({x}, ''), '{titles.NOISE}', '', 'g'))"
_bared = lambda x: f"regexp_replace(trim(coalesce({x}, '')), '{titles.ORDINAL}', '')"
_tk = lambda x: f"regexp_replace({_qk(_bared(x))}, '{titles.DECORATION}', '', 'g')"
_grams = lambda x: f"list_distinct(list_transform(range(1, length({x})), lambda i: {x}[i:i + 1]))"


def relevance_sql(q: str, t: str) -> str:
    """The fit of a title's key to a query's key."""
    both = f"len(list_intersect({_grams(q)}, {_grams(t)}))"
    share = f"0.7::DOUBLE * {both} / greatest(len({_grams(q)}), 1) + 0.3::DOUBLE * {both} / greatest(len({_grams(t)}), 1)"
    return f"CASE WHEN length({q}) < 3 OR length({t}) < 2 THEN 0.0::DOUBLE WHEN contains({t}, {q}) OR contains({q}, {t}) THEN 1.0::DOUBLE ELSE {share} END"


# Requests: some words of the first line of each document.  Sections: seven lines under the words of their first.
HITS = f"""l AS ({SPLIT}), d AS (SELECT doc_id, trim(split_part(min(line) FILTER (k = 0), ' ', 1) || ' ' || split_part(min(line) FILTER (k = 0), ' ', 2)) AS query FROM l GROUP BY doc_id),
h0 AS (SELECT l.doc_id AS query_id, query, k // 7 AS section, k AS seq, ((l.doc_id * 7 + k * 13) % 100) / 100.0::DOUBLE AS score, k % 5 = 0 AS ask, line FROM l JOIN d ON d.doc_id = l.doc_id),
h1 AS (SELECT *, '一、' || left(first_value(line) OVER (PARTITION BY query_id, section ORDER BY seq), 14) || '概述' AS title, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS rnk, section % 3 = 2 AS missing FROM h0),
h AS (SELECT *, CASE WHEN section % 2 = 0 THEN query || ' 流程 ' || title ELSE '' END AS path FROM h1)"""


def hits(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    rows = split_lines(spark, d)
    first = rows.filter("k = 0").select(F.col("doc_id").alias("query_id"), F.trim(F.concat_ws(" ", F.split_part("line", F.lit(" "), F.lit(1)), F.split_part("line", F.lit(" "), F.lit(2)))).alias("query"))
    k, doc = F.col("k"), F.col("doc_id")
    made = rows.select(doc.alias("query_id"), F.floor(k / 7).alias("section"), k.alias("seq"), ((doc * 7 + k * 13) % 100 / 100.0).alias("score"), (k % 5 == 0).alias("ask"), "line")
    head = F.first("line").over(Window.partitionBy("query_id", "section").orderBy("seq"))
    title = F.concat(F.lit("一、"), F.substring(head, 1, 14), F.lit("概述"))
    ranked = made.withColumn("title", title).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "seq")))
    out = ranked.join(first, "query_id").withColumn("missing", F.col("section") % 3 == 2)
    return out.withColumn("path", F.when(F.col("section") % 2 == 0, F.concat("query", F.lit(" 流程 "), "title")).otherwise(""))


def _ranked_sql(fit: str, each: float, most: int, weak: str) -> str:
    return f"""WITH {HITS}, f AS (SELECT *, {_tk("query")} AS q, {_tk("title")} AS t, {_tk("path")} AS p FROM h),
g AS (SELECT query_id, section, min(seq) AS seq, count(*) AS n_hits, max(score) AS best, min(rnk) AS first, max({fit}) AS fit, bool_and({weak}) AS weak FROM f GROUP BY query_id, section),
s AS (SELECT *, fit >= 0.45 AS strong, best + 0.35::DOUBLE * fit + {each}::DOUBLE * least(n_hits - 1, {most}) - CASE WHEN weak THEN 0.08::DOUBLE ELSE 0 END AS score FROM g),
r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY strong DESC, round(score, 9) DESC, first) <= 3)
SELECT query_id, section, seq, n_hits, strong, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY seq, section) AS place FROM r"""


@query(_ranked_sql(relevance_sql("q", "t"), 0.01, 2, "ask"))
def r6_08_ranked_sections(spark: SparkSession, d: str) -> DataFrame:
    """The best three sections of an outline for the first words of each document."""
    found = sections.best_sections(hits(spark, d).withColumn("weak", F.col("ask")))
    return found.withColumn("score", F.round("score", 6)).withColumn("place", F.col("place").cast("long"))


@query(_ranked_sql(f"greatest({relevance_sql('q', 't')}, {relevance_sql('q', 'p')})", 0.015, 3, "missing"))
def r6_09_ranked_document_sections(spark: SparkSession, d: str) -> DataFrame:
    """The best three sections of a document, by title or heading path."""
    found = sections.best_sections(hits(spark, d).withColumn("weak", F.col("missing")), by_path=True)
    return found.withColumn("score", F.round("score", 6)).withColumn("place", F.col("place").cast("long"))


_both = lambda q, t: f"len(list_intersect({_grams(q)}, {_grams(t)}))"


@query(f"""WITH t AS (SELECT page_id, html, '第二章' || left(regexp_extract(html, '<title>([^<]*)</title>', 1), 30) || CASE page_id % 3 WHEN 0 THEN '简介' WHEN 1 THEN '！' ELSE '' END AS title, CASE page_id % 4 WHEN 0 THEN left(regexp_extract(html, '<title>([^<]*)</title>', 1), 12) WHEN 1 THEN '如何' || regexp_extract(html, '<title>([^<]*)</title>', 1) || '的常见流程'
  WHEN 2 THEN right(regexp_extract(html, '<h1>([^<]*)</h1>', 1), 20) ELSE 'the thing' END AS query FROM pages),
k AS (SELECT page_id, {_qk("query")} AS q, {_qk("title")} AS p, {_tk(_qk("query"))} AS cq, {_tk("title")} AS ct, {_tk("query")} AS rq FROM t)
SELECT page_id, CASE WHEN p = '' THEN 0 WHEN contains(p, q) THEN 10000 + length(q) WHEN length(p) >= 4 AND contains(q, p) THEN 8000 + length(p) WHEN length(cq) >= 3 AND contains(ct, cq) THEN 9000 + length(cq) WHEN length(ct) >= 4 AND contains(cq, ct) THEN 8500 + length(ct)
  WHEN {_both("q", "p")} >= 3 THEN {_both("q", "p")} ELSE 0 END::BIGINT AS score, round({relevance_sql("rq", "ct")}, 6) AS fit FROM k""")
def r8_25_page_titles(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the titles of pages, as chapters, for queries made of their words."""
    title, head, page = F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), F.col("page_id")
    end = F.when(page % 3 == 0, "简介").when(page % 3 == 1, "！").otherwise("")
    asked = F.when(page % 4 == 0, F.substring(title, 1, 12)).when(page % 4 == 1, F.concat(F.lit("如何"), title, F.lit("的常见流程"))).when(page % 4 == 2, F.right(head, F.lit(20))).otherwise("the thing")
    rows = table(spark, d, "pages").select("page_id", F.concat(F.lit("第二章"), F.substring(title, 1, 30), end).alias("title"), asked.alias("query"))
    return rows.select("page_id", titles.title_score(titles.query_key(F.col("query")), F.col("title")).cast("long").alias("score"), F.round(titles.section_relevance(F.col("query"), F.col("title")), 6).alias("fit"))

"""Pages and texts to blocks with places, main content and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.operators import pages
from siltworks.registry import query
from siltworks.sources.readers import table

_in = lambda names: "(" + ", ".join(f"'{x}'" for x in names) + ")"
_clean = lambda x: f"trim(regexp_replace({x}, '{pages.SPACE}', ' ', 'g'))"
_token = pages.TOKEN.replace("'", "''")
#: The references that these pages have.
_unescaped = "regexp_replace(replace(replace(replace(token, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g')"
_walk = lambda names: f"sum(CASE WHEN tag IN {_in(names)} THEN opens - closes ELSE 0 END) OVER w"
_edges = _in([*pages.HEADINGS, *pages.PARAGRAPHS, "li"])
MARKED = rf"""h AS (SELECT row_number() OVER () AS r, page_id, regexp_extract_all(coalesce(html, ''), '{_token}') AS l FROM pages),
t0 AS (SELECT r, page_id, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS place FROM h),
t1 AS (SELECT *, regexp_matches(token, '^<!|^(?i:<script\b|<style\b)') AS raw, lower(regexp_extract(token, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) AS name FROM t0),
t2 AS (SELECT *, CASE WHEN NOT raw AND name <> '' THEN name END AS tag FROM t1),
t3 AS (SELECT r, page_id, place, token, raw, tag, (tag IS NOT NULL AND NOT starts_with(token, '</') AND NOT ends_with(token, '/>') AND tag NOT IN {_in(pages.VOID)})::INT AS opens, (tag IS NOT NULL AND starts_with(token, '</'))::INT AS closes,
  sum(length(token)) OVER (PARTITION BY r ORDER BY place) AS stop FROM t2),
t4 AS (SELECT *, {_walk(pages.SKIPPED)} AS s, {_walk(["a"])} AS a, {_walk(pages.CONTAINERS)} AS c FROM t3 WINDOW w AS (PARTITION BY r ORDER BY place)),
t5 AS (SELECT *, raw OR s > least(0, min(s) OVER w) AS skipped, a > least(0, min(a) OVER w) AS linked, c - least(0, min(c) OVER w) AS nested FROM t4 WINDOW w AS (PARTITION BY r ORDER BY place)),
mk AS (SELECT *, coalesce(NOT skipped AND tag IN {_edges}, false) AS edge, sum(coalesce(NOT skipped AND tag IN {_edges}, false)::INT) OVER (PARTITION BY r ORDER BY place) AS block FROM t5),
pc AS (SELECT r, page_id, block, place, linked, CASE WHEN edge THEN CASE WHEN opens = 1 AND tag IN {_in(pages.HEADINGS)} THEN 'heading' WHEN opens = 1 AND tag = 'li' THEN 'list' ELSE 'paragraph' END END AS kind,
  CASE WHEN edge AND opens = 1 AND tag IN {_in(pages.HEADINGS)} THEN tag[2]::INT END AS level, CASE WHEN tag = 'br' THEN ' ' WHEN tag IS NULL THEN {_clean(_unescaped)} END AS piece FROM mk WHERE NOT skipped),
bl0 AS (SELECT r, page_id, block, coalesce(max(kind), 'paragraph') AS kind, max(level) AS level, {_clean("coalesce(string_agg(piece, '' ORDER BY place) FILTER (piece <> ''), '')")} AS text,
  coalesce(sum(length(piece)) FILTER (linked AND piece <> ' '), 0) AS link_chars, min(place) FILTER (piece NOT IN ('', ' ')) AS place FROM pc GROUP BY r, page_id, block),
bl AS (SELECT *, length(text) AS chars FROM bl0 WHERE text <> '' AND NOT regexp_matches(text, '{"|".join(pages.NOISE)}'))"""
_numbered = lambda name, of: f"""{name} AS (SELECT *, sum(length(line) + 2) OVER w - 2 - length(line) AS start, sum(length(line) + 2) OVER w - 2 AS "end", row_number() OVER w AS seq FROM (
  SELECT *, CASE WHEN kind = 'heading' THEN repeat('#', coalesce(level, 2)) || ' ' || text WHEN kind = 'list' AND NOT regexp_matches(text, '^[-*] ') THEN '- ' || text ELSE text END AS line FROM {of}) WINDOW w AS (PARTITION BY r ORDER BY block))"""  # noqa: E731
_size = f"CASE WHEN NOT skipped AND tag IS NULL THEN length({_clean('token')}) ELSE 0 END"
MAIN = rf"""{MARKED},
k0 AS (SELECT r, place, tag, opens, closes, nested, coalesce(lag(nested) OVER w, 0) AS was, sum({_size}) OVER w AS sum, sum(CASE WHEN linked THEN {_size} ELSE 0 END) OVER w AS links,
  max(place) OVER (PARTITION BY r) + 1 AS fin FROM mk WINDOW w AS (PARTITION BY r ORDER BY place)),
k1 AS (SELECT *, max(sum) OVER p AS total, max(links) OVER p AS all_links FROM k0 WINDOW p AS (PARTITION BY r)),
k2 AS (SELECT *, CASE WHEN opens = 1 THEN nested ELSE was END AS deep FROM k1 WHERE tag IN {_in(pages.CONTAINERS)} AND (opens = 1 OR (closes = 1 AND was > 0))),
k3 AS (SELECT *, coalesce(lead(place) OVER v, fin) AS last, coalesce(lead(sum) OVER v, total) - sum AS chars, coalesce(lead(links) OVER v, all_links) - links AS own_links FROM k2 WINDOW v AS (PARTITION BY r, deep ORDER BY place)),
best AS (SELECT r, first({{'f': place, 'l': last}} ORDER BY deep DESC, place) AS b FROM k3 WHERE opens = 1 AND total > all_links AND chars - own_links >= (total - all_links) * 0.5 GROUP BY r),
inside AS (SELECT bl.* FROM bl LEFT JOIN best ON best.r = bl.r WHERE link_chars <= 0.5 * chars AND (b IS NULL OR (place > b.f AND place < b.l))),
{_numbered("mb", "inside")}"""


@query(f"""WITH {MARKED} SELECT page_id, count(*) AS n_tokens, max(stop)::BIGINT AS n_chars, count(tag) AS n_tags, sum(opens)::BIGINT AS n_opened, sum(closes)::BIGINT AS n_closed, count(*) FILTER (skipped) AS n_skipped,
count(*) FILTER (linked AND tag IS NULL AND NOT skipped) AS n_linked, max(block)::BIGINT AS n_edges, sum(place * length(token))::BIGINT AS mark FROM mk GROUP BY page_id, r""")
def r10_01_page_tokens(spark: SparkSession, d: str) -> DataFrame:
    """What the event table of each page holds; its pieces are the page's characters."""
    rows = pages.marked(pages.tokens(table(spark, d, "pages")))
    return rows.groupBy("row", "page_id").agg(
        F.count("*").alias("n_tokens"),
        F.max("end").alias("n_chars"),
        F.count("tag").alias("n_tags"),
        F.count_if("opens").alias("n_opened"),
        F.count_if("closes").alias("n_closed"),
        F.count_if("skipped").alias("n_skipped"),
        F.count_if(F.col("linked") & F.col("tag").isNull() & ~F.col("skipped")).alias("n_linked"),
        F.max("block").alias("n_edges"),
        F.sum(F.col("place") * F.length("token")).alias("mark"),
    ).drop("row")


@query(f"""WITH {MARKED}, {_numbered("nb", "bl")} SELECT page_id, count(*) AS n_blocks, count(*) FILTER (kind = 'heading') AS n_headings, count(*) FILTER (kind = 'list') AS n_items, sha256(string_agg(line, chr(10) || chr(10) ORDER BY seq)) AS text FROM nb GROUP BY page_id, r""")
def r1_09_fallback_text(spark: SparkSession, d: str) -> DataFrame:
    """All blocks of a page that aren't left out, as marked-down text."""
    rows = pages.numbered(pages.blocks(table(spark, d, "pages")))
    counts = rows.groupBy("row").agg(F.count_if(F.col("kind") == "heading").alias("n_headings"), F.count_if(F.col("kind") == "list").alias("n_items"))
    return pages.page_text(rows).join(counts, "row").select("page_id", "n_blocks", "n_headings", "n_items", F.sha2("text", 256).alias("text"))


@query(f"""WITH {MAIN} SELECT page_id, count(*) AS n_blocks, sum(chars)::BIGINT AS n_chars, sum(link_chars)::BIGINT AS link_chars, sha256(string_agg(line, chr(10) || chr(10) ORDER BY seq)) AS text FROM mb GROUP BY page_id, r""")
def r1_08_main_content(spark: SparkSession, d: str) -> DataFrame:
    rows = pages.main_content(table(spark, d, "pages"))
    counts = rows.groupBy("row").agg(F.sum("chars").alias("n_chars"), F.sum("link_chars").alias("link_chars"))
    return pages.page_text(rows).join(counts, "row").select("page_id", "n_blocks", "n_chars", "link_chars", F.sha2("text", 256).alias("text"))


@query(f"""WITH {MAIN} SELECT page_id, seq, kind, level, start::BIGINT AS start, "end"::BIGINT AS "end", link_chars::BIGINT AS link_chars, sha256(text) AS text FROM mb""")
def r10_01_page_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of the main content, with their places in its text."""
    rows = pages.main_content(table(spark, d, "pages"))
    return rows.select("page_id", "seq", "kind", "level", "start", "end", "link_chars", F.sha2("text", 256).alias("text"))


# Documents' lines as parts between blank lines, every 9th a heading of some level, and a list item, a table and code now and then.
def _planted() -> Column:
    n, line = F.col("n"), F.col("line")
    head = F.concat(F.repeat(F.lit("#"), (F.col("doc_id") + n / 9).cast("int") % 4 + 1), F.lit(" "), line)
    lesson = F.concat(F.lit("第一章 "), F.substring("line", 1, 20))
    grid = F.concat(F.lit("|a|b|\n|-|-|\n|"), line, F.lit("|"))
    return F.when(n % 9 == 0, head).when(n % 9 == 2, F.concat(F.lit("  - "), line)).when(n % 9 == 4, grid).when(n % 9 == 5, F.concat(F.lit("```\n"), line)).when(n % 9 == 7, lesson).otherwise(line)


_sql_planted = """CASE n % 9 WHEN 0 THEN repeat('#', ((doc_id + n // 9) % 4 + 1)::INT) || ' ' || line WHEN 2 THEN '  - ' || line WHEN 4 THEN '|a|b|' || chr(10) || '|-|-|' || chr(10) || '|' || line || '|'
  WHEN 5 THEN '```' || chr(10) || line WHEN 7 THEN '第一章 ' || left(line, 20) ELSE line END"""
MADE = rf"""x0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents WHERE text IS NOT NULL),
x1 AS (SELECT doc_id, string_agg({_sql_planted}, chr(10) || '  ' || chr(10) ORDER BY n) AS text FROM x0 GROUP BY doc_id),
x2 AS (SELECT doc_id, text, string_split_regex(text, '\n\s*\n') AS parts, list_prepend('', regexp_extract_all(text, '\n\s*\n')) AS gaps FROM x1),
x3 AS (SELECT doc_id, unnest(parts) AS part, unnest(gaps) AS gap, generate_subscripts(parts, 1) AS n FROM x2),
x4 AS (SELECT *, regexp_replace(part, '^\s+|\s+$', '', 'g') AS b, sum(length(part) + length(gap)) OVER (PARTITION BY doc_id ORDER BY n) - length(regexp_replace(part, '^\s+', '')) AS start FROM x3),
x5 AS (SELECT *, {_clean("regexp_replace(regexp_replace(b, '^(\\*\\*|__)\\s*', ''), '\\s*(\\*\\*|__)$', '')")} AS e, regexp_extract(b, '{pages.MARKED_HEADING}', 1) AS marks FROM x4 WHERE b <> ''),
x6 AS (SELECT *, length(e) <= 80 AND (regexp_matches(e, '{pages.NUMBERED_HEADING}') OR (starts_with(b, '**') AND ends_with(b, '**'))) AS short FROM x5),
tb AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS seq, CASE WHEN marks <> '' OR short THEN 'heading' WHEN regexp_matches(b, '^([-*] |\d+[.)、]\s+)') THEN 'list' WHEN regexp_matches(b, '{pages.TABLE_RULE}') THEN 'table' WHEN starts_with(b, '```') THEN 'code' ELSE 'paragraph' END AS kind,
  CASE WHEN marks <> '' THEN length(marks) WHEN short THEN 2 END AS level, CASE WHEN marks <> '' THEN trim(regexp_extract(b, '{pages.MARKED_HEADING}', 2)) WHEN short THEN e ELSE
  {_clean("regexp_replace(regexp_replace(regexp_replace(b, '!\\[[^\\]]*]\\([^)]+\\)', '', 'g'), '\\[([^\\]]+)]\\([^)]+\\)', '\\1', 'g'), '[*_`>#-]+', ' ', 'g')")} END AS text, start, start + length(b) AS "end" FROM x6)"""


def marked_down(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("line", _planted())
    lines = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("lines"))
    return lines.select("doc_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n  \n").alias("text"))


@query(f"""WITH {MADE} SELECT doc_id, seq, kind, level, start::BIGINT AS start, "end"::BIGINT AS "end", sha256(text) AS text FROM tb""")
def r10_01_text_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of marked-down texts with their places, over documents with planted headings, items, tables and code."""
    rows = pages.text_blocks(marked_down(spark, d), "doc_id", "text")
    return rows.select("doc_id", "seq", "kind", "level", "start", "end", F.sha2("text", 256).alias("text"))


@query(f"""WITH {MADE}, s0 AS (SELECT *, sum((kind = 'heading')::INT) OVER (PARTITION BY doc_id ORDER BY seq) AS k, max((kind = 'heading')::INT) OVER (PARTITION BY doc_id) AS any_head FROM tb),
s1 AS (SELECT doc_id, CASE WHEN any_head = 0 THEN 1 ELSE k END AS section, CASE WHEN any_head = 0 THEN '正文' ELSE left(arg_min(text, seq), 120) END AS heading, CASE WHEN any_head = 0 THEN 1 ELSE coalesce(arg_min(level, seq), 1) END AS level,
  min(seq) AS first_seq, max(seq) AS last_seq, arg_min(start, seq) AS start, max("end") AS "end" FROM s0 WHERE k > 0 OR any_head = 0 GROUP BY doc_id, k, any_head)
SELECT doc_id, section::BIGINT AS section, sha256(heading) AS heading, level, (SELECT max(p.section) FROM s1 p WHERE p.doc_id = s1.doc_id AND p.section < s1.section AND p.level < s1.level)::BIGINT AS parent, first_seq, last_seq, start::BIGINT AS start, "end"::BIGINT AS "end" FROM s1""")
def r10_02_text_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = pages.sections(pages.text_blocks(marked_down(spark, d), "doc_id", "text"), ["doc_id"])
    return rows.withColumn("heading", F.sha2("heading", 256)).withColumn("section", F.col("section").cast("long"))

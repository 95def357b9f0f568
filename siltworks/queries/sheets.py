"""Sheets made of documents, fingerprints of pages, tags of payloads and scopes of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions import titles
from siltworks.operators import facts, sheets
from siltworks.queries.facts import FACTS, chunks
from siltworks.queries.lines import SPLIT, split_lines
from siltworks.queries.payloads import _tags
from siltworks.queries.titles import _qk
from siltworks.registry import query
from siltworks.sources.readers import table

LABELS = {"职位": "title", "Job": "title", "薪资(元)": "salary", "城市": "city"}
_cells = """CASE WHEN k < doc_id % 3 THEN [left(line, 5), '……', ''] WHEN k = doc_id % 3 THEN CASE doc_id % 4 WHEN 0 THEN ['职位', ' 薪资（元） ', 'x', 'ＪＯＢ'] WHEN 1 THEN ['城市', 'note', ' job'] WHEN 2 THEN ['城市', '城市x'] ELSE ['a', '薪资(元)', '', '城市'] END
 ELSE [split_part(line, ' ', 1), split_part(line, ' ', 2), CASE WHEN k % 3 = 0 THEN ' ' ELSE split_part(line, ' ', 3) END, split_part(line, ' ', 4)] END"""


def made(spark: SparkSession, d: str) -> DataFrame:
    """Documents as sheets: some rows before a header, the header, and words of the lines as cells."""
    return split_lines(spark, d).select(F.col("doc_id").alias("sheet"), F.col("k").alias("row"), F.expr(_cells.replace("[", "array(").replace("]", ")")).alias("cells"))


_label = "CASE lower(trim(replace(translate(x, '（）　ＪＯＢ', '() JOB'), chr(160), ' '))) WHEN '职位' THEN 'title' WHEN 'job' THEN 'title' WHEN '薪资(元)' THEN 'salary' WHEN '城市' THEN 'city' END"
SHEETS = f"""l AS ({SPLIT}), s AS (SELECT doc_id AS sheet, k AS row, {_cells} AS cells FROM l), e AS (SELECT sheet, row, unnest(cells) AS x, generate_subscripts(cells, 1) AS i FROM s), f AS (SELECT *, {_label} AS field FROM e),
h AS (SELECT sheet, min(row) AS head FROM (SELECT sheet, row FROM f GROUP BY sheet, row HAVING count(field) >= 2) GROUP BY sheet)"""


@query(f"WITH {SHEETS} SELECT h.sheet, head::INT AS row, array_to_string(cells, '|') AS cells FROM h JOIN s ON s.sheet = h.sheet AND s.row = head")
def r10_34_header_rows(spark: SparkSession, d: str) -> DataFrame:
    return sheets.header_rows(made(spark, d), LABELS).select("sheet", "row", F.array_join("cells", "|").alias("cells"))


@query(f"""WITH {SHEETS}, n AS (SELECT f.sheet, f.i, f.field FROM f JOIN h ON h.sheet = f.sheet AND h.head = f.row WHERE field IS NOT NULL),
r AS (SELECT f.sheet, f.row, n.field, arg_max(f.x, f.i) AS x FROM f JOIN h ON h.sheet = f.sheet JOIN n ON n.sheet = f.sheet AND n.i = f.i WHERE f.row > head AND trim(f.x) <> '' GROUP BY ALL)
SELECT sheet, row::INT AS row, count(*) AS n, sha256(string_agg(field || '=' || x, ';' ORDER BY field)) AS record FROM r GROUP BY sheet, row""")
def r9_37_records_by_header(spark: SparkSession, d: str) -> DataFrame:
    """Rows after the header by the fields that its labels stand for."""
    rows = sheets.records(made(spark, d), LABELS)
    said = F.array_join(F.transform(F.sort_array(F.map_entries("record")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return rows.select("sheet", "row", F.size("record").cast("long").alias("n"), F.sha2(said, 256).alias("record"))


@query(r"""WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n|\r', chr(10), 'g'), '(?m)[ \t\f]+$', '', 'g'), chr(32) || chr(10) || chr(9) || chr(11) || chr(12)) AS content, coalesce(source, '') AS title FROM documents)
SELECT doc_id, sha256('{"content":' || to_json(content)::VARCHAR || ',"title":' || to_json(title)::VARCHAR || '}') AS fingerprint FROM t WHERE NOT contains(content, chr(160))""")
def r9_18_content_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").filter(~F.coalesce("text", F.lit("")).contains("\xa0"))
    return rows.select("doc_id", sheets.content_fingerprint(F.col("source"), F.col("text")).alias("fingerprint"))


# NFKC makes plain blanks of no-break ones; the tables hold no other compatibility characters.
@query(r"""WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(160), ' '), '\r\n|\r', chr(10), 'g'), '(?m)[ \t\f]+$', '', 'g'), chr(32) || chr(10) || chr(9) || chr(11) || chr(12)) AS content,
trim(replace(coalesce(source, ''), chr(160), ' ')) AS title FROM documents)
SELECT doc_id, sha256('{"content":' || to_json(content)::VARCHAR || ',"title":' || to_json(title)::VARCHAR || '}') AS fingerprint FROM t""")
def r9_18_whole_content_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Of all documents, those with no-break spaces among them."""
    return table(spark, d, "documents").select("doc_id", sheets.content_fingerprint(F.col("source"), F.col("text")).alias("fingerprint"))


@query(f"""WITH p AS (SELECT event_id, {_tags} AS t FROM events), q AS (SELECT event_id, t::JSON AS j FROM p WHERE t IS NOT NULL AND json_valid(t)),
x AS (SELECT event_id, 'topics' AS bucket, unnest(json_extract(j, '$[*]')) AS x, generate_subscripts(json_extract(j, '$[*]'), 1) - 1 AS i FROM q WHERE json_type(j) = 'ARRAY' AND event_id % 7 = 0
  UNION ALL SELECT event_id, 'topics', unnest(json_extract(j, '$.topics[*]')), generate_subscripts(json_extract(j, '$.topics[*]'), 1) - 1 FROM q WHERE event_id % 7 = 1
  UNION ALL SELECT event_id, 'regions', unnest(json_extract(j, '$.regions[*]')), generate_subscripts(json_extract(j, '$.regions[*]'), 1) - 1 FROM q WHERE event_id % 7 = 1),
v AS (SELECT event_id, bucket, i, trim(CASE WHEN json_type(x) = 'VARCHAR' THEN x->>'$' ELSE x->>'$.value' END) AS v FROM x)
SELECT event_id, bucket, v AS value FROM v WHERE v <> '' QUALIFY row_number() OVER (PARTITION BY event_id, bucket, lower(v) ORDER BY i) = 1""")
def r8_23_tag_rows(spark: SparkSession, d: str) -> DataFrame:
    """Tags of payloads planted on events."""
    rows = table(spark, d, "events").select("event_id", F.expr(_tags).alias("t"))
    return sheets.tag_rows(rows, "event_id", "t").select("event_id", "bucket", "value")


@query(f"""WITH {FACTS}, r AS (SELECT doc_id, reason, count(*) AS n FROM x GROUP BY ALL) SELECT doc_id, coalesce(sum(n) FILTER (reason IS NULL), 0)::BIGINT AS n_accepted, coalesce(sum(n) FILTER (reason IS NOT NULL), 0)::BIGINT AS n_refused,
coalesce(string_agg(reason || '=' || n, ';' ORDER BY reason) FILTER (reason IS NOT NULL), '') AS reasons FROM r GROUP BY doc_id""")
def r4_17_extraction_rollup(spark: SparkSession, d: str) -> DataFrame:
    """What extraction gave for each document, with a count of each reason."""
    rows = facts.summary(facts.extract(chunks(spark, d)).withColumn("refused", F.col("reason")), "doc_id")
    said = F.array_join(F.transform(F.map_entries("reasons"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return rows.select("doc_id", "n_accepted", "n_refused", said.alias("reasons"))


# Nodes: titles of pages, a third of them tasks; requests: words of every fiftieth page's title, some asking for a node.
_nodes = """n AS (SELECT page_id AS node, CASE WHEN page_id % 3 = 0 THEN 'task_outline' ELSE 'knowledge_outline' END AS kind, CASE WHEN page_id % 6 = 0 THEN 'task' ELSE 'step' END AS node_type, left(regexp_extract(html, '<title>([^<]*)</title>', 1), 24) AS title, page_id AS place FROM pages)"""
_score = f"CASE WHEN p = '' THEN 0 WHEN contains(p, q) THEN 10000 + length(q) WHEN length(p) >= 4 AND contains(q, p) THEN 8000 + length(p) WHEN length(cq) >= 3 AND contains(ct, cq) THEN 9000 + length(cq) WHEN length(ct) >= 4 AND contains(cq, ct) THEN 8500 + length(ct) ELSE 0 END"
_bared = lambda x: f"regexp_replace(trim({x}), '{titles.ORDINAL}', '')"
_tk = lambda x: f"regexp_replace({_qk(_bared(x))}, '{titles.DECORATION}', '', 'g')"
_request = "CASE item_id % 4 WHEN 0 THEN left(title, 9) WHEN 1 THEN '如何' || title || '？' WHEN 2 THEN 'zq' || item_id ELSE title END"


@query(f"""WITH {_nodes}, b AS (SELECT item_id FROM benchmark), r AS (SELECT item_id AS request, {_request} AS query, CASE WHEN item_id % 10 = 7 THEN item_id WHEN item_id % 10 = 8 THEN -1 END AS asked FROM b JOIN n ON n.node = b.item_id * 3 % 50),
g AS (SELECT request, asked AS node, coalesce(kind, 'unknown') AS kind, true AS mandatory, CASE WHEN kind IS NULL THEN 'node_not_found' ELSE 'caller_selected_node' END AS reason FROM r LEFT JOIN n ON n.node = r.asked WHERE asked IS NOT NULL),
k AS (SELECT request, query, node, kind, place, {_qk("query")} AS q, {_qk("title")} AS p, {_tk(_qk("query"))} AS cq, {_tk("title")} AS ct FROM r, n WHERE asked IS NULL AND (kind = 'knowledge_outline' OR node_type = 'task')),
s AS (SELECT *, {_score} AS score FROM k WHERE length(q) >= 3), t AS (SELECT * FROM s WHERE score >= 8000 QUALIFY row_number() OVER (PARTITION BY request ORDER BY kind = 'task_outline' DESC, score DESC, place) = 1)
SELECT * FROM g UNION ALL SELECT r.request, t.node, t.kind, false, CASE WHEN t.node IS NOT NULL THEN CASE WHEN t.kind = 'task_outline' AND regexp_matches(r.query, '{"|".join(sheets.STEPS)}') THEN 'query_title_containment_operation_steps' ELSE 'query_title_containment' END END
FROM r LEFT JOIN t ON t.request = r.request WHERE asked IS NULL""")
def r8_24_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Scopes among titles of pages for a request for each benchmark item."""
    page, title = F.col("page_id"), F.substring(F.regexp_extract("html", "<title>([^<]*)</title>", 1), 1, 24)
    kind, step = F.when(page % 3 == 0, "task_outline").otherwise("knowledge_outline"), F.when(page % 6 == 0, "task").otherwise("step")
    nodes = table(spark, d, "pages").select(page.alias("node"), kind.alias("kind"), step.alias("node_type"), title.alias("title"), page.alias("place"))
    items = table(spark, d, "benchmark").select("item_id", (F.col("item_id") * 3 % 50).alias("node")).join(nodes.select("node", "title"), "node")
    asked = F.when(F.col("item_id") % 10 == 7, F.col("item_id")).when(F.col("item_id") % 10 == 8, -1)
    requests = items.select(F.col("item_id").alias("request"), F.expr(_request).alias("query"), asked.alias("asked"))
    return sheets.scopes(requests, nodes)

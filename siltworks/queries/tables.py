"""Record tables and metric cards in planted blocks of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.operators import tables
from siltworks.registry import query
from siltworks.sources.readers import table

RECORD = "| 序号 | 时间 | 部门 | 内容 |\n|:---|----|:---:|---|\n"
MATRIX = "项目 | 2020 | 2021年 | 2022\n---|---|---|---\n"
WIDE = "| 名称 | 说明 |\n| --- | --- |\n"


def planted(spark: SparkSession, d: str) -> DataFrame:
    """A block for each document: its lines as rows of a record table, a matrix or a table of two columns, by id, some of them rows that go on; or its text."""
    lines = table(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    bare, k, doc = F.replace("line", F.lit("|"), F.lit(" ")), F.col("k"), F.col("doc_id")
    said = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    record = F.when(k % 3 == 2, said("| | |  | ", F.substring(bare, 1, 30), " |")).when(k % 7 == 3, said("| | | ", F.substring(bare, 1, 5), "<br>x | y |")).when(k % 11 == 5, "| odd | row |")
    record = record.otherwise(said("| ", k.cast("string"), " | ", (2000 + k % 20).cast("string"), " | ", F.substring(bare, 1, 8), " |  ", bare, " |"))
    matrix = said(k.cast("string"), " | ", F.length("line").cast("string"), " | 1,", (100 + k).cast("string"), " | 7%")
    row = F.when(doc % 4 == 0, record).when(doc % 4 == 1, matrix).when(doc % 4 == 2, said("| ", F.substring(bare, 1, 9), " | ", bare, " |")).otherwise(F.col("line"))
    texts = lines.select("doc_id", F.struct("k", row.alias("row")).alias("x")).groupBy("doc_id").agg(F.sort_array(F.collect_list("x")).alias("rows"))
    head = F.when(doc % 4 == 0, RECORD).when(doc % 4 == 1, MATRIX).when(doc % 4 == 2, WIDE).otherwise("")
    hint = F.when(doc % 24 == 5, " Row_Atomic ").when(doc % 24 == 4, "layout")
    return texts.select(
        "doc_id",
        F.lit(1).alias("seq"),
        F.when(doc % 4 == 3, "paragraph").otherwise("table").alias("block_type"),
        F.concat(head, F.array_join(F.transform("rows", lambda x: x["row"]), "\n")).alias("text"),
        hint.alias("hint"),
        F.when(doc % 8 == 0, F.concat(F.lit(" 表 "), doc.cast("string"))).alias("caption"),
    )


_words = lambda words: "|".join(words)
_split = "list_transform(string_split(regexp_replace(regexp_replace({}, '^\\|', ''), '\\|$', ''), '|'), lambda c: regexp_replace(regexp_replace(replace(regexp_replace(c, '^\\s+|\\s+$', '', 'g'), '<br>', ' / '), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'))"
_nl = "chr(10)"
PLANTED = rf"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents WHERE text IS NOT NULL),
l2 AS (SELECT doc_id, k, line, replace(line, '|', ' ') AS bare FROM l),
l3 AS (SELECT doc_id, k, CASE doc_id % 4 WHEN 0 THEN CASE WHEN k % 3 = 2 THEN '| | |  | ' || left(bare, 30) || ' |' WHEN k % 7 = 3 THEN '| | | ' || left(bare, 5) || '<br>x | y |' WHEN k % 11 = 5 THEN '| odd | row |'
    ELSE '| ' || k || ' | ' || (2000 + k % 20) || ' | ' || left(bare, 8) || ' |  ' || bare || ' |' END
  WHEN 1 THEN k || ' | ' || length(line) || ' | 1,' || (100 + k) || ' | 7%' WHEN 2 THEN '| ' || left(bare, 9) || ' | ' || bare || ' |' ELSE line END AS row FROM l2),
pb AS (SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'paragraph' ELSE 'table' END AS block_type, CASE doc_id % 4 WHEN 0 THEN '{RECORD}' WHEN 1 THEN '{MATRIX}' WHEN 2 THEN '{WIDE}' ELSE '' END || string_agg(row, chr(10) ORDER BY k) AS text,
  CASE doc_id % 24 WHEN 5 THEN 'row_atomic' WHEN 4 THEN 'layout' END AS hint, CASE WHEN doc_id % 8 = 0 THEN '表 ' || doc_id ELSE '表格行记录' END AS caption FROM l3 GROUP BY doc_id),
n0 AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\r\n|\r|\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: contains(x, '|')) AS p FROM pb WHERE block_type = 'table'),
n1 AS (SELECT doc_id, p, list_filter(range(2, len(p) + 1), lambda i: regexp_matches(p[i], '{tables.RULE}'))[1] AS rl FROM n0 WHERE len(p) >= 3),
n2 AS (SELECT doc_id, p, rl, {_split.format("p[rl - 1]")} AS h FROM n1 WHERE rl IS NOT NULL),
n3 AS (SELECT doc_id, h, unnest(p[rl + 1:]) AS raw, generate_subscripts(p[rl + 1:], 1) AS n FROM n2 WHERE len(list_filter(h, lambda x: x = '')) = 0),
n4 AS (SELECT *, {_split.format("raw")} AS c FROM n3),
n5 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i, list_filter(range(1, len(c) + 1), lambda k: c[k] <> '') AS filled, list_filter(range(1, len(h)), lambda k: regexp_matches(h[k], '{_words(tables.STRONG_WORDS)}')) AS naming FROM n4 WHERE len(c) = len(h) AND len(list_filter(c, lambda x: x <> '')) > 0),
n6 AS (SELECT *, i > 1 AND (filled = [len(c)] OR (len(naming) > 0 AND len(list_filter(naming, lambda k: c[k] <> '')) = 0 AND list_min(filled) >= list_max(naming))) AS more FROM n5),
n7 AS (SELECT *, sum((NOT more)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n6),
n8 AS (SELECT doc_id, any_value(h) AS h, run, list(c ORDER BY i) AS cs, string_agg(raw, chr(10) ORDER BY i) AS raw FROM n7 GROUP BY doc_id, run),
n9 AS (SELECT doc_id, h, run, raw, list_transform(range(1, len(h) + 1), lambda k: array_to_string(list_filter(list_transform(cs, lambda x: x[k]), lambda x: x <> ''), ' ')) AS c FROM n8),
t0 AS (SELECT doc_id, any_value(h) AS h, count(*) AS n_rows, flatten(list(c[2:])) AS cells FROM n9 GROUP BY doc_id),
t1 AS (SELECT t0.*, hint, len(list_filter(h, lambda x: regexp_matches(x, '{_words(tables.STRONG_WORDS)}'))) AS strong, len(list_filter(h, lambda x: regexp_matches(x, '{_words(tables.RECORD_WORDS)}'))) AS hits,
  len(list_filter(h[2:], lambda x: regexp_matches(x, '{tables.YEAR}') OR length(x) <= 4)) AS vl, len(list_filter(cells, lambda x: regexp_matches(regexp_replace(x, '[,%]', '', 'g'), '{tables.NUMBER}'))) AS nums FROM t0 JOIN pb USING (doc_id)),
t2 AS (SELECT doc_id, h, n_rows, CASE WHEN hint = 'layout' THEN false WHEN hint = 'row_atomic' THEN true ELSE len(h) BETWEEN 3 AND 10 AND n_rows >= 2 AND (strong >= 2 OR (len(h) >= 4 AND strong >= 1 AND hits >= 2))
  AND NOT (len(h) >= 4 AND ((vl >= greatest(3, len(h) - 2) AND h[1] IN ('{"', '".join(tables.MATRIX_HEADS)}')) OR (nums >= 0.8 * len(cells) AND vl >= 2))) END AS apart FROM t1),
tu AS (SELECT doc_id, block_type, text, NULL::INT AS row, NULL::INT AS start, NULL::INT AS "end", NULL::BIGINT AS n_rows FROM pb WHERE doc_id NOT IN (SELECT doc_id FROM t2 WHERE apart)
  UNION ALL SELECT doc_id, 'table', '表格概览：共 ' || n_rows || ' 条记录；字段：' || array_to_string(h, ' / '), 0, NULL, NULL, n_rows FROM t2 WHERE apart
  UNION ALL SELECT n9.doc_id, 'table_row', caption || ' | ' || array_to_string(list_transform(list_filter(range(1, len(n9.h) + 1), lambda k: c[k] <> ''), lambda k: n9.h[k] || ': ' || c[k]), ' | '), run, nullif(instr(text, raw) - 1, -1),
    nullif(instr(text, raw) - 1, -1) + length(raw), n_rows FROM n9 JOIN t2 ON t2.doc_id = n9.doc_id AND apart JOIN pb ON pb.doc_id = n9.doc_id)"""


@query(f"""WITH {PLANTED} SELECT doc_id, block_type, row::INT AS row, start::INT AS start, "end"::INT AS "end", n_rows::INT AS n_rows, sha256(text) AS text FROM tu""")
def r10_13_table_rows(spark: SparkSession, d: str) -> DataFrame:
    """Blocks with record tables taken apart to an overview and rows; matrices and other blocks as they are."""
    units = tables.explode_tables(planted(spark, d))
    return units.select("doc_id", "block_type", "row", "start", "end", "n_rows", F.sha2("text", 256).alias("text"))


@query(f"""WITH {PLANTED} SELECT t1.doc_id, hint, len(h) AS n_columns, t1.n_rows, strong, hits, apart FROM t1 JOIN (SELECT doc_id, apart FROM t2) USING (doc_id)""")
def r10_14_record_test(spark: SparkSession, d: str) -> DataFrame:
    """What the test of a record table sees in each table, and its verdict."""
    rows = planted(spark, d).filter("block_type = 'table'").select("doc_id", "hint", tables.parse(F.col("text")).alias("t")).filter("t is not null")
    hits = lambda words: F.size(F.filter("t.headers", lambda h: h.rlike("|".join(words)))).cast("long")
    return rows.select("doc_id", F.lower(F.trim("hint")).alias("hint"), F.size("t.headers").cast("long").alias("n_columns"), F.size("t.rows").cast("long").alias("n_rows"), hits(tables.STRONG_WORDS).alias("strong"), hits(tables.RECORD_WORDS).alias("hits"), tables.is_record_table(F.col("t"), F.col("hint")).alias("apart"))


@query(f"""WITH {PLANTED} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (more) AS n_continued, max(run)::BIGINT AS n_rows, sum(len(list_filter(c, lambda x: x <> '')))::BIGINT AS n_filled FROM n7 GROUP BY doc_id""")
def r10_15_continued_rows(spark: SparkSession, d: str) -> DataFrame:
    """How many lines of each table were put to the row before."""
    rows = planted(spark, d).filter("block_type = 'table'").select("doc_id", tables.parse(F.col("text")).alias("t")).filter("t is not null")
    total = lambda f: F.aggregate("t.rows", F.lit(0).cast("long"), lambda a, r: a + f(r))
    lines = total(lambda r: F.size(F.split(r["raw"], "\n")))
    filled = total(lambda r: F.aggregate(F.split(r["raw"], "\n"), F.lit(0), lambda a, x: a + F.size(F.filter(F.split(F.regexp_replace(F.regexp_replace(x, r"^\|", ""), r"\|$", ""), r"\|"), lambda c: F.trim(c) != ""))))
    return rows.select("doc_id", lines.alias("n_lines"), (lines - F.size("t.rows")).alias("n_continued"), F.size("t.rows").cast("long").alias("n_rows"), filled.alias("n_filled"))


CARDS = rf"""b AS (SELECT doc_id, CASE WHEN k % 9 = 8 THEN k + 1 ELSE k END + k // 9 AS seq, CASE WHEN k % 4 = 3 THEN 'paragraph' ELSE 'heading' END AS block_type, CASE k % 6 WHEN 0 THEN '## 核心运行指标' WHEN 1 THEN '同比增长 ' || (k % 10) || '%' WHEN 2 THEN '# ' || k || '.5 亿元 ' || left(line, 10)
  WHEN 4 THEN '第' || '一章 3 家' ELSE line END AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents WHERE text IS NOT NULL)),
s AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(text, '^\s+', ''), '^#+', ''), '^\s+|\s+$', '', 'g') AS said FROM b),
v AS (SELECT *, block_type = 'heading' AND said <> '' AND NOT regexp_matches(said, '{tables.SECTION_HEADING}') AND regexp_matches(said, '{tables.METRIC_VALUE}') AS value,
  block_type = 'heading' AND said <> '' AND NOT regexp_matches(said, '{tables.SECTION_HEADING}') AND NOT regexp_matches(said, '{tables.METRIC_VALUE}') AND regexp_matches(said, '{tables.METRIC_GROUP}') AS grp FROM s),
w AS (SELECT *, CASE WHEN lag(grp) OVER o AND lag(seq) OVER o = seq - 1 THEN lag(seq) OVER o END AS was, lag(said) OVER o AS before FROM v WINDOW o AS (PARTITION BY doc_id ORDER BY seq))"""


@query(f"""WITH {CARDS} SELECT doc_id, coalesce(was, seq)::BIGINT AS seq, CASE WHEN was IS NULL THEN 1 ELSE 2 END::BIGINT AS n_consumed, sha256(CASE WHEN was IS NULL THEN said ELSE before || chr(10) || said END) AS text FROM w WHERE value""")
def r10_16_metric_cards(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as blocks, some of them headings with figures or of groups of figures."""
    lines = table(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    k = F.col("k")
    text = F.when(k % 6 == 0, "## 核心运行指标").when(k % 6 == 1, F.concat(F.lit("同比增长 "), (k % 10).cast("string"), F.lit("%"))).when(k % 6 == 2, F.concat(F.lit("# "), k.cast("string"), F.lit(".5 亿元 "), F.substring("line", 1, 10)))
    text = text.when(k % 6 == 4, "第一章 3 家").otherwise(F.col("line"))
    seq = (F.when(k % 9 == 8, k + 1).otherwise(k) + F.floor(k / 9)).cast("long")
    blocks = lines.select("doc_id", seq.alias("seq"), F.when(k % 4 == 3, "paragraph").otherwise("heading").alias("block_type"), text.alias("text"))
    return tables.metric_cards(blocks).select("doc_id", "seq", F.size("consumed").cast("long").alias("n_consumed"), F.sha2("text", 256).alias("text"))

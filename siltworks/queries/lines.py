"""Entries, triples and headings in documents with planted lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.operators import headings, lines
from siltworks.registry import query
from siltworks.sources.readers import table

SPLIT = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents WHERE text IS NOT NULL"
_BARE = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def split_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))


_fields = "|".join(lines.TAG_FIELDS)


@query(rf"""WITH l AS ({SPLIT}),
p AS (SELECT doc_id, k, {_BARE.format("CASE k % 6 WHEN 1 THEN '标签名：' || left(line, 12) WHEN 2 THEN ' 分类 : ' || length(line) WHEN 3 THEN '分类:b' || k WHEN 4 THEN '描述：' WHEN 5 THEN ' ' ELSE line END")} AS s FROM l),
e AS (SELECT *, s <> '' AND coalesce(lag(s) OVER w = '', true) AS opens, sum((s <> '')::INT) OVER w AS x FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
n AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY k) - 1 AS entry FROM e WHERE s <> ''),
g AS (SELECT doc_id, entry, k, CASE WHEN regexp_matches(s, '^({_fields})\s*[:：]\s*(.+)') THEN regexp_extract(s, '^({_fields})\s*[:：]\s*(.+)', 1) WHEN opens THEN '{lines.TAG_FIELDS[0]}' END AS field,
  CASE WHEN regexp_matches(s, '^({_fields})\s*[:：]\s*(.+)') THEN trim(regexp_extract(s, '^({_fields})\s*[:：]\s*(.+)', 2)) ELSE s END AS value FROM n),
f AS (SELECT doc_id, entry, field, arg_max(value, k) AS value FROM g WHERE field IS NOT NULL GROUP BY ALL)
SELECT doc_id, entry::BIGINT AS entry, sha256(coalesce(max(value) FILTER (field = '{lines.TAG_FIELDS[0]}'), 'tag_' || entry)) AS name, count(*) AS n_fields, sha256(string_agg(field || '=' || value, ';' ORDER BY field)) AS fields FROM f GROUP BY doc_id, entry""")
def r10_27_tag_entries(spark: SparkSession, d: str) -> DataFrame:
    k, line = F.col("k"), F.col("line")
    said = F.when(k % 6 == 1, F.concat(F.lit("标签名："), F.substring(line, 1, 12))).when(k % 6 == 2, F.concat(F.lit(" 分类 : "), F.length(line).cast("string"))).when(k % 6 == 3, F.concat(F.lit("分类:b"), k.cast("string"))).when(k % 6 == 4, "描述：").when(k % 6 == 5, " ").otherwise(line)
    found = lines.entries(split_lines(spark, d).select("doc_id", k.alias("seq"), said.alias("line")))
    pairs = F.array_join(F.transform(F.sort_array(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select("doc_id", "entry", F.sha2("name", 256).alias("name"), F.size("fields").cast("long").alias("n_fields"), F.sha2(pairs, 256).alias("fields"))


_related = "CASE k % 5 WHEN 1 THEN ' ' || left(line, 6) || ' --[' || (k % 3) || ' x]→ ' || right(line, 5) WHEN 3 THEN left(line, 5) || ' 包含 ' || left(line, 2) ELSE line END"


@query(rf"""WITH l AS ({SPLIT}), p AS (SELECT doc_id, k, {_related} AS line FROM l),
b AS (SELECT doc_id, k, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) - 1 - length(line) AS start, {_BARE.format("line")} AS s FROM p),
t AS (SELECT doc_id, k AS n, start, start + length(line) AS stop, regexp_matches(s, '{lines.NAMED_RELATION}') AS named, s FROM b WHERE regexp_matches(s, '{lines.NAMED_RELATION}') OR regexp_matches(s, '{lines.PLAIN_RELATION}')),
x AS (SELECT doc_id, n, start, stop, {_BARE.format(f"CASE WHEN named THEN regexp_extract(s, '{lines.NAMED_RELATION}', 1) ELSE regexp_extract(s, '{lines.PLAIN_RELATION}', 1) END")} AS subject,
  CASE WHEN named THEN {_BARE.format(f"regexp_extract(s, '{lines.NAMED_RELATION}', 2)")} ELSE '{lines.RELATED}' END AS predicate, {_BARE.format(f"CASE WHEN named THEN regexp_extract(s, '{lines.NAMED_RELATION}', 3) ELSE regexp_extract(s, '{lines.PLAIN_RELATION}', 2) END")} AS object FROM t),
bl AS (SELECT doc_id, k // 3 AS seq, 'b' || (k // 3) AS block_id, min(start) AS start, max(start + length(line)) AS stop, string_agg(line, chr(10) ORDER BY k) AS text FROM b GROUP BY doc_id, k // 3),
pr AS (SELECT x.*, list(bl.block_id ORDER BY seq) AS prim FROM x JOIN bl ON bl.doc_id = x.doc_id AND bl.start < greatest(x.stop, x.start) AND bl.stop > x.start GROUP BY ALL),
es AS (SELECT pr.*, (SELECT list(y ORDER BY q) FROM (SELECT block_id AS y, seq AS q FROM bl WHERE bl.doc_id = pr.doc_id AND subject <> '' AND contains(text, subject) AND NOT list_contains(prim, block_id) ORDER BY seq LIMIT 5)) AS e1 FROM pr),
eo AS (SELECT es.*, (SELECT list(y ORDER BY q) FROM (SELECT block_id AS y, seq AS q FROM bl WHERE bl.doc_id = es.doc_id AND object <> '' AND contains(text, object) AND NOT list_contains(prim, block_id) AND NOT coalesce(list_contains(e1, block_id), false) ORDER BY seq LIMIT 5)) AS e2 FROM es)
SELECT doc_id, n::INT AS n, sha256(subject) AS subject, predicate, sha256(object) AS object, start::INT AS start, stop::INT AS "end", array_to_string(prim, ',') AS primary_blocks, array_to_string(list_concat(coalesce(e1, []), coalesce(e2, [])), ',') AS evidence FROM eo""")
def r10_25_triples_with_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Relations planted in lines of documents, three lines a block."""
    k, line = F.col("k"), F.col("line")
    named = F.concat(F.lit(" "), F.substring(line, 1, 6), F.lit(" --["), (k % 3).cast("string"), F.lit(" x]→ "), F.right(line, F.lit(5)))
    said = F.when(k % 5 == 1, named).when(k % 5 == 3, F.concat(F.substring(line, 1, 5), F.lit(" 包含 "), F.substring(line, 1, 2))).otherwise(line)
    rows = split_lines(spark, d).select("doc_id", "k", said.alias("line"))
    texts = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("k", "line"))).alias("x")).select("doc_id", F.transform("x", lambda x: x["line"]).alias("l"))
    whole = texts.select("doc_id", F.array_join("l", "\n").alias("text"))
    parts = texts.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / 3))).alias("seq"), "l")
    joined = lambda a, b: F.array_join(F.slice("l", a, b), "\n")
    at = F.when(F.col("seq") == 0, 0).otherwise(F.length(joined(F.lit(1), (F.col("seq") * 3).cast("int"))) + 1)
    blocks = parts.select("doc_id", F.concat(F.lit("b"), F.col("seq").cast("string")).alias("block_id"), "seq", joined((F.col("seq") * 3 + 1).cast("int"), F.lit(3)).alias("text"), at.alias("start"))
    blocks = blocks.withColumn("end", F.col("start") + F.length("text"))
    found = lines.with_evidence(lines.triples(whole), blocks)
    return found.select("doc_id", "n", F.sha2("subject", 256).alias("subject"), "predicate", F.sha2("object", 256).alias("object"), "start", "end", F.array_join("primary", ",").alias("primary_blocks"), F.array_join("evidence", ",").alias("evidence"))


@query(rf"""WITH RECURSIVE l AS ({SPLIT}),
h AS (SELECT doc_id, k AS idx, k + 2 * (k // 5) AS block_index, CASE WHEN k % 7 = 6 THEN 'point' ELSE 'chapter' END AS label, CASE WHEN k % 4 < 3 AND (k + doc_id) % 9 <> 4 THEN '项目' || (k % 9 + 1) ELSE left(line, 20) END AS text FROM l),
m AS (SELECT *, row_number() OVER w AS nr, coalesce(label = 'chapter' AND lead(label) OVER w = 'chapter' AND regexp_matches(trim(text), '{headings.BARE_CHAPTER}') AND lead(block_index) OVER w - block_index <= 3, false) AS able FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
r AS (SELECT doc_id, 1::BIGINT AS nr FROM m WHERE nr = 1 UNION ALL SELECT r.doc_id, r.nr + CASE WHEN able THEN 2 ELSE 1 END FROM r JOIN m ON m.doc_id = r.doc_id AND m.nr = r.nr)
SELECT m.doc_id, m.idx::INT AS idx, m.label, m.able AS merged, sha256(CASE WHEN m.able THEN trim(m.text) || ' ' || trim(n.text) ELSE m.text END) AS text FROM r JOIN m ON m.doc_id = r.doc_id AND m.nr = r.nr LEFT JOIN m n ON n.doc_id = m.doc_id AND n.nr = m.nr + 1""")
def r15_07_merged_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as headings, many of them bare chapter numbers; the SQL walks them one after the other."""
    k = F.col("k")
    text = F.when((k % 4 < 3) & ((k + F.col("doc_id")) % 9 != 4), F.concat(F.lit("项目"), (k % 9 + 1).cast("string"))).otherwise(F.substring("line", 1, 20))
    rows = split_lines(spark, d).select("doc_id", k.alias("idx"), (k + 2 * F.floor(k / 5)).alias("block_index"), F.when(k % 7 == 6, "point").otherwise("chapter").alias("label"), text.alias("text"))
    return headings.merge_chapters(rows).select("doc_id", "idx", "label", "merged", F.sha2("text", 256).alias("text"))


_key = r"lower(regexp_replace({}, '[\s，,。.:：；;、]', '', 'g'))"


@query(rf"""WITH l AS ({SPLIT}), t AS (SELECT doc_id, {_key.format("'第' || (k % 6) || '节: ' || left(line, 3)")} AS key, k FROM l WHERE k % 2 = 0),
s AS (SELECT doc_id, key, min(k) AS k FROM t GROUP BY ALL HAVING count(*) = 1 AND key <> ''),
p AS (SELECT doc_id, k AS chunk, unnest(['第' || (k % 6) || '节' || left(line, 3), '第' || ((k + 2) % 6) || '节，' || left(line, 3), NULL, ' ']) AS title, unnest([0, 1, 2, 3]) AS depth FROM l)
SELECT p.doc_id, p.chunk::INT AS chunk, arg_max(s.k, p.depth)::INT AS target FROM p JOIN s ON s.doc_id = p.doc_id AND s.key = {_key.format("p.title")} GROUP BY p.doc_id, p.chunk""")
def r15_08_lifted_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as chunks with a path of titles, every other one a heading as well."""
    k, line, rows = F.col("k"), F.substring("line", 1, 3), split_lines(spark, d)
    of = lambda n, mark: F.concat(F.lit("第"), n.cast("string"), F.lit(f"节{mark}"), line)
    targets = rows.filter("k % 2 = 0").select("doc_id", of(k % 6, ": ").alias("title"), k.alias("target"))
    chunks = rows.select("doc_id", k.alias("chunk_id"), F.array(of(k % 6, ""), of((k + 2) % 6, "，"), F.lit(None).cast("string"), F.lit(" ")).alias("path"))
    return headings.lift(chunks, targets).select("doc_id", F.col("chunk_id").alias("chunk"), "target")


def joined(spark: SparkSession, d: str, planted: str) -> DataFrame:
    """Documents whose lines ``planted``, an expression of k, line and doc_id, has changed."""
    rows = split_lines(spark, d).select("doc_id", F.struct("k", F.expr(planted).alias("line")).alias("x")).groupBy("doc_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return rows.select("doc_id", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("text"))


_measured = "CASE WHEN k % 6 = 5 THEN '' WHEN doc_id % 4 = 0 THEN line WHEN k % 6 = 1 THEN ' 指标：' || left(line, 12) WHEN k % 6 = 2 THEN '权重: ' || k WHEN k % 6 = 3 THEN '指标:b' || k WHEN k % 12 = 4 THEN '评分标准：' ELSE line END"
_field = "^(" + "|".join(lines.INDICATOR_FIELDS) + r")\s*[:：]\s*(.+)"
#: Paragraphs of texts pt (doc_id, text) without fields.
_plain = rf"""pp AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS p FROM pt), pq AS (SELECT doc_id, unnest(p) AS raw, generate_subscripts(p, 1) AS i FROM pp),
pr AS (SELECT *, {_BARE.format("raw")} AS c, sum(length(raw) + 2) OVER (PARTITION BY doc_id ORDER BY i) - 2 - length(regexp_replace(raw, '^\s+', '')) AS start FROM pq), pv AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n, c, start, start + length(c) AS stop FROM pr WHERE c <> '')"""


@query(rf"""WITH l AS ({SPLIT}), p AS (SELECT doc_id, k, {_measured} AS line FROM l), t AS (SELECT doc_id, k, line, {_BARE.format("line")} AS s, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) - 1 - length(line) AS start FROM p),
e AS (SELECT *, s <> '' AND coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY k) = '', true) AS opens FROM t), n AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY k) - 1 AS n FROM e WHERE s <> ''),
g AS (SELECT doc_id, n, regexp_extract(s, '{_field}', 1) AS f, {_BARE.format(f"arg_max(regexp_extract(s, '{_field}', 2), k)")} AS v, min(k) AS k, min(start) AS start, max(start + length(line)) AS stop FROM n WHERE regexp_matches(s, '{_field}') GROUP BY ALL),
i AS (SELECT doc_id, n, string_agg(f || ': ' || v, chr(10) ORDER BY k) AS c, min(start) AS start, max(stop) AS stop FROM g GROUP BY doc_id, n), pt AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY k) AS text FROM p WHERE doc_id NOT IN (SELECT doc_id FROM g) GROUP BY doc_id), {_plain}
SELECT doc_id, n::BIGINT AS n, sha256(c) AS content, start::INT AS start, stop::INT AS "end" FROM (SELECT * FROM i UNION ALL SELECT * FROM pv)""")
def r10_23_indicators(spark: SparkSession, d: str) -> DataFrame:
    """Indicators of documents with planted fields; every fourth document has none and gives its paragraphs."""
    return lines.indicators(joined(spark, d, _measured)).select("doc_id", "n", F.sha2("content", 256).alias("content"), "start", "end")


_stepped = "CASE WHEN k % 6 = 5 THEN '' WHEN doc_id % 3 = 0 THEN line WHEN k % 4 = 1 THEN ' 步骤 ' || k || '：' || line WHEN k % 12 = 3 THEN 'Step2.' WHEN k % 12 = 7 THEN '阶段、 x' ELSE line END"
_mark = r"^\s*(步骤|阶段|Step)\s*[0-9]*[:：.、]\s*"


@query(rf"""WITH l AS ({SPLIT}), p AS (SELECT doc_id, k, {_stepped} AS line FROM l), m AS (SELECT doc_id, k, line, regexp_extract(line, '{_mark}', 1) AS title, sum((regexp_matches(line, '{_mark}'))::INT) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM p),
s AS (SELECT doc_id, run, max(title) AS title, {_BARE.format(f"string_agg(regexp_replace(line, '{_mark}', ''), chr(10) ORDER BY k)")} AS c FROM m WHERE run > 0 GROUP BY doc_id, run),
x AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS n, title, c FROM s WHERE c <> ''), pt AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY k) AS text FROM p WHERE doc_id NOT IN (SELECT doc_id FROM x) GROUP BY doc_id), {_plain}
SELECT doc_id, n::INT AS n, title, sha256(c) AS content FROM x UNION ALL SELECT doc_id, n, '段落' || (n + 1), sha256(c) FROM pv""")
def r10_22_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps of documents with planted marks; every third document has none and gives its paragraphs."""
    return lines.steps(joined(spark, d, _stepped)).select("doc_id", "n", "title", F.sha2("content", 256).alias("content"))

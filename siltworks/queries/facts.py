"""Facts by rule and their validation, over lines of documents with planted roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.operators import facts
from siltworks.queries.lines import SPLIT, split_lines
from siltworks.registry import query
from siltworks.sources.readers import table

_role = "CASE k % 5 WHEN 0 THEN 'table_row' WHEN 1 THEN 'metric_image' WHEN 2 THEN 'chart' WHEN 3 THEN 'body' END"
#: Some lines state fields or figures; some facts are then given another's words, evidence or confidence.
_content = """CASE WHEN k % 5 = 0 AND doc_id % 3 < 2 THEN '| 部门: ' || left(line, 9) || ' |' || chr(10) || '内容：' || line || chr(10) || '政策: p' || k || chr(10) || '部门:' || k || CASE WHEN k % 2 = 0 THEN chr(10) || '标准:' ELSE '' END
 WHEN k % 5 IN (1, 2) AND doc_id % 3 > 0 THEN left(line, 20) || chr(10) || ' 电商产值 ' || k || '.5 亿元' || chr(10) || 'rest: 7%' ELSE line END"""
_values = {
    "literal": "CASE WHEN k % 11 = 4 THEN 'entirely foreign words' WHEN k % 11 = 5 THEN repeat('长', 3000) ELSE object_literal END",
    "evidence": "CASE WHEN k % 13 = 6 THEN 'plain' ELSE evidence_text END",
    "confidence": "CASE WHEN k % 17 = 2 THEN 1.5 WHEN k % 17 = 5 THEN NULL ELSE confidence END",
}
_bare = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_ln = r"string_split_regex(coalesce({}, ''), '\r\n|\r|\n')"
FACTS = rf"""l AS ({SPLIT}), c AS (SELECT doc_id, k, {_role} AS role, {_content} AS content FROM l),
kv0 AS (SELECT doc_id, k, unnest({_ln.format("content")}) AS x, generate_subscripts({_ln.format("content")}, 1) AS i FROM c WHERE role = 'table_row'),
kv1 AS (SELECT doc_id, k, i, regexp_replace(x, '^[ \t|]+|[ \t|]+$', '', 'g') AS x FROM kv0),
kv2 AS (SELECT doc_id, k, i, {_bare.format("split_part(x, CASE WHEN contains(x, ':') THEN ':' ELSE '：' END, 1)")} AS key, {_bare.format("substr(x, instr(x, CASE WHEN contains(x, ':') THEN ':' ELSE '：' END) + 1)")} AS value FROM kv1 WHERE contains(x, ':') OR contains(x, '：')),
kv3 AS (SELECT doc_id, k, key, min(i) AS i, arg_max(value, i) AS value FROM kv2 WHERE key <> '' AND value <> '' GROUP BY ALL),
kv AS (SELECT doc_id, k, string_agg(key || ': ' || value, '; ' ORDER BY i) AS literal, coalesce({", ".join(f"max(value) FILTER (key = '{s}')" for s in facts.SUBJECTS)}, '{facts.RECORD}') AS name FROM kv3 GROUP BY doc_id, k),
m0 AS (SELECT doc_id, k, list_filter(list_transform({_ln.format("content")}, lambda x: {_bare.format("x")}), lambda x: regexp_matches(x, '{facts.METRIC}'))[1] AS x FROM c WHERE role IN ('metric_image', 'chart')),
m AS (SELECT doc_id, k, {_bare.format(f"regexp_extract(x, '{facts.METRIC}', 1)")} AS name, {_bare.format(f"regexp_extract(x, '{facts.METRIC}', 2)")} AS value FROM m0 WHERE x IS NOT NULL),
x AS (SELECT c.*, CASE WHEN role IS NULL OR role = 'body' THEN 'unsupported_extractor' WHEN kv.name IS NULL AND m.name IS NULL THEN 'no_fact_candidate' END AS reason, coalesce(m.name, kv.name) AS subject_name, coalesce(m.value, kv.literal) AS object_literal,
  CASE WHEN m.name IS NOT NULL OR kv.name IS NOT NULL THEN content END AS evidence_text, CASE role WHEN 'metric_image' THEN 0.82 ELSE 0.78 END AS confidence FROM c LEFT JOIN kv ON kv.doc_id = c.doc_id AND kv.k = c.k LEFT JOIN m ON m.doc_id = c.doc_id AND m.k = c.k)"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return split_lines(spark, d).select("doc_id", "k", F.expr(_role).alias("role"), F.expr(_content.replace("chr(10)", "'\\n'")).alias("content"))


@query(f"""WITH {FACTS} SELECT doc_id, k::INT AS k, reason, sha256(subject_name) AS subject_name, sha256(object_literal) AS object_literal, CASE WHEN reason IS NULL THEN confidence::DOUBLE END AS confidence,
CASE WHEN reason IS NULL THEN CASE WHEN role = 'table_row' THEN 'policy_fact' ELSE 'metric_fact' END END AS fact_type FROM x""")
def r15_23_extracted_facts(spark: SparkSession, d: str) -> DataFrame:
    found = facts.extract(chunks(spark, d))
    return found.select("doc_id", "k", "reason", F.sha2("subject_name", 256).alias("subject_name"), F.sha2("object_literal", 256).alias("object_literal"), "confidence", "fact_type")


_foreign = lambda v: f"(trim({v}) <> '' AND NOT regexp_matches({v}, '{facts.HAN}') AND regexp_matches({v}, '[A-Za-z]{{2,}}') AND NOT contains(regexp_replace(lower(content), '[^a-z0-9]+', '', 'g'), regexp_replace(lower({v}), '[^a-z0-9]+', '', 'g')) AND (len(regexp_extract_all({v}, '[A-Za-z]{{2,}}')) >= 2 OR (length(trim({v})) >= 16 AND contains(trim({v}), ' '))))"


@query(f"""WITH {FACTS}, y AS (SELECT doc_id, content, reason, subject_name AS s, {_values["literal"]} AS o, {_values["evidence"]} AS e, {_values["confidence"]} AS c FROM x),
z AS (SELECT doc_id, CASE WHEN reason IS NOT NULL THEN reason WHEN regexp_matches(content, '{facts.HAN}') AND ((e <> '' AND NOT regexp_matches(e, '{facts.HAN}')) OR {_foreign("o")} OR {_foreign("s")}) THEN 'language_mismatch'
  WHEN coalesce(c NOT BETWEEN 0 AND 1, true) OR length(o) > 2048 OR trim(o) = '' OR length(e) > 4096 OR trim(e) = '' OR length(s) > 512 OR trim(s) = '' THEN 'schema_invalid' END AS r FROM y)
SELECT doc_id % 50 AS part, count(*) FILTER (r IS NULL) AS n_accepted, count(r) AS n_refused, count(*) FILTER (r = 'language_mismatch') AS n_language, count(*) FILTER (r = 'schema_invalid') AS n_schema, count(*) FILTER (r = 'no_fact_candidate') AS n_without FROM z GROUP BY 1""")
def r15_24_validated_facts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of accepted and refused facts, some of which were spoilt on the way."""
    found = facts.extract(chunks(spark, d))
    spoilt = found.withColumns({"object_literal": F.expr(_values["literal"]), "evidence_text": F.expr(_values["evidence"]), "confidence": F.expr(_values["confidence"])}).withColumn("part", F.col("doc_id") % 50)
    n = lambda why: F.coalesce(F.try_element_at("reasons", F.lit(why)), F.lit(0)).alias
    counts = facts.summary(facts.validated(spoilt, "content"), "part")
    return counts.select("part", "n_accepted", "n_refused", n("language_mismatch")("n_language"), n("schema_invalid")("n_schema"), n("no_fact_candidate")("n_without"))


_stated = "CASE WHEN k % 4 = 1 THEN '产值为: ' || k || '.25 亿元。' || line WHEN k % 4 = 2 THEN line || '！占比 ' || k || '%' ELSE line END"
_cases = lambda i: " ".join(f"WHEN '{u}' THEN {x[i]!r}" for u, x in facts.UNITS.items())


@query(rf"""WITH l AS ({SPLIT}), t AS (SELECT doc_id, string_agg({_stated}, chr(10) ORDER BY k) AS text FROM l GROUP BY doc_id), p AS (SELECT doc_id, regexp_extract_all(text, '{facts.SENTENCE}') AS p FROM t),
s0 AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) - 1 AS n FROM p), s AS (SELECT *, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY n) AS stop FROM s0),
v AS (SELECT doc_id, n, stop - length(s) AS start, stop, {_bare.format("s")} AS s FROM s), w AS (SELECT *, {_bare.format(f"regexp_extract(s, '{facts.METRIC}', 1)")} AS name, {_bare.format(f"regexp_extract(s, '{facts.METRIC}', 2)")} AS value FROM v WHERE regexp_matches(s, '{facts.METRIC}')),
u AS (SELECT *, {_bare.format("regexp_replace(value, '^[-+]?[0-9]+([.][0-9]+)?', '')")} AS unit FROM w)
SELECT doc_id, n::INT AS n, start::INT AS start, stop::INT AS "end", sha256(name) AS name, regexp_extract(value, '^[-+]?[0-9]+([.][0-9]+)?')::DOUBLE * (CASE unit {_cases(0)} ELSE 1 END)::DOUBLE AS number, CASE unit {_cases(1)} ELSE '' END AS unit FROM u""")
def r15_23_metric_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Figures stated by sentences of documents, with their places, in plain units."""
    rows = split_lines(spark, d).select("doc_id", F.struct("k", F.expr(_stated).alias("line")).alias("x")).groupBy("doc_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    said = facts.sentences(rows.select("doc_id", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("text")), "doc_id", "text")
    metric = said.withColumn("m", facts.first_metric(F.col("sentence"))).filter("m is not null").withColumn("v", facts.normal_value(F.col("m.value")))
    return metric.select("doc_id", "n", "start", "end", F.sha2("m.name", 256).alias("name"), "v.number", "v.unit")


_meta = {
    "anchor_role": "CASE k % 9 WHEN 0 THEN 'body' WHEN 1 THEN 'image' WHEN 2 THEN 'table_overview' WHEN 3 THEN 'equation' WHEN 4 THEN 'table_row' WHEN 5 THEN 'image' WHEN 6 THEN '' END",
    "graph_candidate": "CASE k % 13 WHEN 4 THEN 'false' WHEN 7 THEN 'skip' WHEN 8 THEN 'true' END",
    "profile": "CASE WHEN k % 19 = 6 THEN 'task_outline' END",
    "domain_model": "CASE WHEN k % 23 = 9 THEN 'task_outline.v1' END",
    "low_quality": "k % 17 = 9",
    "image_role": "CASE WHEN k % 7 = 1 THEN 'QRCode' WHEN k % 7 = 2 THEN 'photo' END",
    "caption": "CASE WHEN k % 5 = 0 THEN '登录界面' WHEN k % 5 = 1 THEN '结构图' END",
}
_said = "CASE WHEN k % 29 = 10 THEN '  ' WHEN k % 8 = 5 THEN '<label> 保存 <label>' WHEN k % 31 = 1 THEN ' Logo ' ELSE line END"
_screens = "(len(regexp_extract_all(coalesce(caption, '') || chr(10) || s, '{w}')))"


@query(rf"""WITH l AS ({SPLIT}), c AS (SELECT doc_id, k, {_bare.format(_said)} AS s, k % 9 = 7 AS step, {", ".join(f"{v} AS {k}" for k, v in _meta.items())} FROM l),
r AS (SELECT *, CASE WHEN coalesce(anchor_role, '') <> '' THEN anchor_role WHEN step THEN 'body' ELSE '' END AS role FROM c),
p AS (SELECT *, coalesce(lower(image_role) IN ('{"', '".join(facts.PICTURE_ROLES)}'), false) OR lower(s) IN ('{"', '".join(facts.PICTURE_TEXTS)}') OR (coalesce(caption, '') <> '结构图' AND (len(regexp_extract_all(s, '<label>')) >= 2 OR (coalesce(caption, '') = '登录界面' AND
  (len(regexp_extract_all(s, '<label>')) >= 1 OR 1 + len(regexp_extract_all(lower(s), '登录|保存')) >= 2 OR (starts_with(s, '-') OR starts_with(s, '*') OR starts_with(s, '•')) AND false)))) AS picture FROM r),
w AS (SELECT doc_id, CASE WHEN s = '' THEN 'empty_content' WHEN graph_candidate = 'false' OR profile = 'task_outline' OR domain_model = 'task_outline.v1' THEN 'task_outline_not_graph_candidate' WHEN role = '' THEN 'missing_anchor_role' WHEN role = 'table_overview' THEN 'skipped_anchor_role'
  WHEN role NOT IN ('{"', '".join(facts.ACCEPTED)}') THEN 'unsupported_anchor_role' WHEN low_quality OR graph_candidate = 'skip' THEN 'low_quality_chunk' WHEN role = 'image' AND picture THEN 'non_semantic_image' END AS reason FROM p)
SELECT doc_id, reason, count(*) AS n FROM w GROUP BY ALL""")
def r11_08_candidate_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Why lines of documents, as chunks with planted metadata, are no candidates; by document."""
    rows = split_lines(spark, d)
    meta = F.struct(*[F.expr(v).alias(k) for k, v in _meta.items()])
    chunks_ = rows.select("doc_id", F.expr(_said).alias("content"), F.when(F.col("k") % 9 == 7, "process_step").alias("chunk_type"), meta.alias("metadata"))
    return chunks_.withColumn("reason", facts.skip_reason()).groupBy("doc_id", "reason").agg(F.count("*").alias("n"))

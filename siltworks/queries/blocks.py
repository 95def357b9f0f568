"""Repacking of blocks, step by step and as a chain, over blocks made from the lines of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions import noise
from siltworks.operators import blocks
from siltworks.registry import query
from siltworks.sources.readers import table

ODD = {3: "12", 4: "Page 3 of 9", 5: "图 1-2: caption", 6: "***", 7: "本书责任编辑：甲 封面设计：乙 出版社：丙 邮政编码", 8: "- item"}


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as blocks: every 7th a heading, every 5th an image, some replaced by what the rules are about."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    kind = F.when(F.col("p") % 7 == 0, "heading").when(F.col("p") % 5 == 1, "image").otherwise("paragraph")
    text = F.col("line")
    for k, said in ODD.items():
        text = F.when(F.col("p") % 13 == k, said).otherwise(text)
    return rows.select("doc_id", F.col("p").cast("long").alias("seq"), kind.alias("block_type"), F.floor(F.col("p") / 6).alias("page"), text.alias("text"))


_cases = " ".join(f"WHEN {k} THEN '{v}'" for k, v in ODD.items())
_quoted = blocks.TERMINATORS.replace("'", "''")
LINES = f"""b AS (SELECT doc_id, p AS seq, CASE WHEN p % 7 = 0 THEN 'heading' WHEN p % 5 = 1 THEN 'image' ELSE 'paragraph' END AS block_type, p // 6 AS page, CASE p % 13 {_cases} ELSE line END AS text
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM documents))"""
NAV = f"""{LINES}, n AS (SELECT * FROM b WHERE NOT (block_type IN ('heading', 'title') OR (block_type = 'paragraph' AND ltrim(text) LIKE '#%' AND contains(left(ltrim(text), 6), ' '))))"""
MEAN = rf"""{NAV}, m AS (SELECT * FROM n WHERE block_type = 'image' OR NOT (regexp_matches(trim(text), '(?i)^\s*(第\s*[0-9]+\s*页|[-—]\s*[0-9]+\s*[-—]|Page\s+[0-9]+(\s+of\s+[0-9]+)?|P[.\s]*[0-9]+)\s*$')
OR regexp_matches(trim(text), '^[0-9]{{1,4}}$') OR regexp_matches(trim(text), '^[^\p{{L}}\p{{N}}]*$') OR length(regexp_replace(text, '\s+', '', 'g')) < 4))"""
ATT = rf"""{MEAN}, a AS (SELECT *, block_type = 'paragraph' AND length(trim(text)) <= 120 AND (regexp_matches(text, '^\s*(数据来源|资料来源|来源)\s*[:：]') OR regexp_matches(text, '^\s*注[0-9]*[：:]') OR regexp_matches(text, '^\s*[图表]\s*[0-9]+([-－.][0-9]+)*[\s:：]')
  OR regexp_matches(text, '(?i)^\s*(Figure|Fig\.?|Table|Source)\s*[:：]?\s*[0-9]')) AS named, CASE WHEN block_type = 'image' THEN seq END AS ms, CASE WHEN block_type = 'image' THEN page END AS mp FROM m),
h AS (SELECT *, last_value(ms IGNORE NULLS) OVER u AS bs, last_value(mp IGNORE NULLS) OVER u AS bp, coalesce(lead(ms, 1) OVER w, lead(ms, 2) OVER w, lead(ms, 3) OVER w) AS fs FROM a
  WINDOW w AS (PARTITION BY doc_id ORDER BY seq), u AS (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, CASE WHEN named THEN CASE WHEN abs(bp - page) <= 1 THEN bs ELSE fs END END AS host FROM h),
f AS (SELECT l.doc_id, l.seq, l.block_type, l.page, l.text, coalesce((SELECT string_agg(x.text, '|' ORDER BY x.seq) FROM g x WHERE x.doc_id = l.doc_id AND x.host = l.seq), '') AS attached FROM g l WHERE l.host IS NULL)"""
CONT = rf"""{ATT}, lv AS (SELECT f.*, (SELECT count(*) FROM b z WHERE z.doc_id = f.doc_id AND z.block_type = 'heading' AND z.seq < f.seq) AS level FROM f),
j AS (SELECT *, coalesce(lag(block_type) OVER w = 'paragraph' AND block_type = 'paragraph' AND lag(level) OVER w = level AND regexp_replace(lag(text) OVER w, '\s+$', '') <> ''
  AND NOT contains('{_quoted}', right(regexp_replace(lag(text) OVER w, '\s+$', ''), 1)) AND ltrim(text) <> '' AND NOT regexp_matches(ltrim(text), '^([#*•·-]|[0-9]+[.、)）]\s)') AND abs(page - lag(page) OVER w) <= 1, false) AS joins FROM lv WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
k AS (SELECT *, sum((NOT joins)::INT) OVER (PARTITION BY doc_id ORDER BY seq) AS run FROM j),
c AS (SELECT doc_id, min(seq) AS seq, arg_min(block_type, seq) AS block_type, arg_min(page, seq) AS page, string_agg(text, '' ORDER BY seq) AS text, count(*) AS n_merged, arg_min(attached, seq) AS attached FROM k GROUP BY doc_id, run)"""
_hits = " + ".join(f"contains(t, '{w}')::INT" for w in blocks.PUBLICATION)
PUB = rf"""{CONT}, q AS (SELECT *, regexp_replace(text, '\s+', '', 'g') AS t FROM c), r AS (SELECT * FROM q WHERE NOT (block_type = 'paragraph' AND length(t) >= 20 AND NOT regexp_matches(t, '{blocks.NOT_PUBLICATION}')
AND (({_hits}) >= 3 OR (({_hits}) >= 2 AND regexp_matches(t, '(?i)(http|www\.|400-[0-9]|ISBN|WBS要素|版权所有)')))))"""
_out = "doc_id, seq, block_type, page, sha256(text) AS text"


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "seq", "block_type", "page", F.sha2("text", 256).alias("text"))


@query(f"WITH {NAV} SELECT {_out} FROM n")
def r10_08_navigational_drop(spark: SparkSession, d: str) -> DataFrame:
    return digest(blocks.navigational(lines(spark, d)))


@query(f"WITH {MEAN} SELECT {_out} FROM m")
def r10_09_meaningless_drop(spark: SparkSession, d: str) -> DataFrame:
    return digest(blocks.meaningless(blocks.navigational(lines(spark, d))))


def hosts(spark: SparkSession, d: str) -> DataFrame:
    return blocks.attributions(blocks.meaningless(blocks.navigational(lines(spark, d))))


@query(f"WITH {ATT} SELECT {_out}, attached FROM f")
def r10_10_attribution_fold(spark: SparkSession, d: str) -> DataFrame:
    rows = hosts(spark, d)
    return rows.select("doc_id", "seq", "block_type", "page", F.sha2("text", 256).alias("text"), F.array_join("attached", "|").alias("attached"))


@query(f"WITH {CONT} SELECT {_out}, n_merged FROM c")
def r10_11_continuation_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = blocks.continuations(hosts(spark, d), lines(spark, d).filter("block_type = 'heading'"))
    return rows.select("doc_id", "seq", "block_type", "page", F.sha2("text", 256).alias("text"), F.size("merged_from").cast("long").alias("n_merged"))


@query(f"WITH {PUB} SELECT {_out} FROM q WHERE seq NOT IN (SELECT seq FROM r WHERE r.doc_id = q.doc_id)")
def r10_12_publication_blocks(spark: SparkSession, d: str) -> DataFrame:
    """What the rule drops."""
    merged = blocks.continuations(hosts(spark, d), lines(spark, d).filter("block_type = 'heading'"))
    return digest(merged.join(blocks.publication_pages(merged).select("doc_id", "seq"), ["doc_id", "seq"], "left_anti"))


@query(f"""WITH {PUB}, s AS (SELECT r.*, (SELECT max_by(z.text, z.seq) FROM b z WHERE z.doc_id = r.doc_id AND z.block_type = 'heading' AND z.seq < r.seq) AS heading FROM r)
SELECT {_out}, attached, n_merged, sha256(heading) AS heading FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, block_type, s.text ORDER BY seq) = 1""")
def r10_18_repacked_units(spark: SparkSession, d: str) -> DataFrame:
    rows = blocks.repack(lines(spark, d))
    return rows.select("doc_id", "seq", "block_type", "page", F.sha2("text", 256).alias("text"), F.array_join("attached", "|").alias("attached"), F.size("merged_from").cast("long").alias("n_merged"), F.sha2("heading", 256).alias("heading"))


#: What lines are replaced by, one in seventeen each: something for every rule.
NOISY = [
    "第 12 页 / 共 80 页", "42", "***---", "ab", "ABOUT US", "责任编辑：某某", "电子商务实践教程", "目 录", "第一章 概述........12", "QR code with central logo", "PART ONE PART TWO",
    "（一）甲乙 12 （二）丙丁 15", "项目一 甲 项目二 乙 项目三 丙 项目四 丁 1 2 3", "一、重点任务", "（3）实训基地建设", "2. 同比增长 5%",
]
_noisy = " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(NOISY))
_block = {
    "block_type": "CASE WHEN k % 7 = 0 THEN 'image' WHEN k % 11 = 3 THEN 'list' WHEN k % 13 = 5 THEN 'table' ELSE 'paragraph' END",
    "page": "k // 6",
    "text": f"CASE (k * 7 + doc_id) % 33 {_noisy} ELSE line END",
    "caption": "CASE WHEN k % 14 = 7 THEN 'A1' WHEN k % 21 = 0 THEN '图 1' END",
    "area": "CASE WHEN k % 2 = 1 THEN 900.0 END",
    "decorative": "k % 29 = 11",
}
_hit = lambda x, patterns: "(" + " OR ".join(f"regexp_matches({x}, '{p}')" for p in patterns) + ")"
_count = lambda x, p: f"len(regexp_extract_all({x}, '{p}'))"
NOISE = rf"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, k AS seq, {", ".join(f"{v} AS {k}" for k, v in _block.items())} FROM l),
s AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS x, coalesce(caption, '') AS c, regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS p, regexp_replace(text, '\s+', '', 'g') AS z FROM b),
w AS (SELECT *, CASE WHEN decorative THEN 'decorative' WHEN block_type = 'image' AND regexp_matches(x, '{noise.QR_CODE}') AND regexp_matches(x, '{noise.QR_ONLY}') THEN 'qr_code'
  WHEN block_type = 'image' AND CASE WHEN c <> '' THEN regexp_matches(c, '{noise.SHORT_LABEL}') AND (x = '' OR regexp_matches(x, '{noise.SYMBOLS}')) AND coalesce(area, 1e9) <= {noise.SMALL_AREA}
    ELSE x = '' OR regexp_matches(x, '{noise.FOOTER}') OR regexp_matches(x, '{noise.DIGITS}') OR regexp_matches(z, '{noise.PAGE_MARK}') OR regexp_matches(x, '{noise.SYMBOLS}') END THEN 'empty_media'
  WHEN block_type IN ('image', 'table') THEN NULL WHEN x = '' THEN 'empty' WHEN regexp_matches(x, '{noise.FOOTER}') THEN 'footer' WHEN regexp_matches(x, '{noise.DIGITS}') THEN 'digits' WHEN regexp_matches(x, '{noise.SYMBOLS}') THEN 'symbols' WHEN length(z) < {noise.LEAST_CHARS} THEN 'short'
  WHEN {_hit("x", noise.PROMOTION)} THEN 'promotion' WHEN {_hit("p", noise.METADATA)} THEN 'metadata' WHEN page <= 5 AND length(z) BETWEEN 8 AND 40 AND NOT regexp_matches(z, '\d') AND regexp_matches(z, '{noise.TITLE_ECHO}') THEN 'title_echo'
  WHEN {_hit("p", noise.CONTENTS)} OR ({_count("p", "PART ")} >= 2 AND length(p) <= 160) OR (regexp_matches(p, '{noise.CONTENTS_RUN}') AND ({_count("p", "\\b\\d{1,3}\\b")} >= 3 OR regexp_matches(p, '{noise.PROJECT_PAGE}')))
    OR ({_count("p", noise.CONTENTS_ITEM)} >= 2 AND length(p) <= 220) THEN 'contents' END AS why FROM s)"""


def noisy(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as blocks with captions and areas, one in two replaced by what a rule is about."""
    rows = table(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    plain = lambda v: v.replace("k // 6", "CAST(floor(k / 6) AS BIGINT)").replace("900.0", "900.0D")
    return rows.select("doc_id", F.col("k").cast("long").alias("seq"), *[F.expr(plain(v)).alias(k) for k, v in _block.items()])


@query(f"WITH {NOISE} SELECT doc_id, coalesce(why, 'kept') AS why, count(*) AS n, sum(seq)::BIGINT AS seqs FROM w GROUP BY ALL")
def r10_09_noise_reasons(spark: SparkSession, d: str) -> DataFrame:
    """How many blocks of a document go for each reason."""
    why = noise.dropped(*[F.col(c) for c in ("block_type", "text", "caption", "page", "area", "decorative")])
    return noisy(spark, d).groupBy("doc_id", F.coalesce(why, F.lit("kept")).alias("why")).agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


@query(rf"""WITH {NOISE} SELECT doc_id, seq, CASE WHEN regexp_matches(x, '^([一二三四五六七八九十]+[、.．]|第[一二三四五六七八九十\d]+[章节篇])') THEN 2 WHEN regexp_matches(x, '^[（(][一二三四五六七八九十]+[）)]') THEN 3 WHEN regexp_matches(x, '^([（(]\d+[）)]|\d+\s*[.．、])') THEN 4 ELSE 3 END AS level
FROM s WHERE block_type IN ('paragraph', 'list') AND length(z) BETWEEN 4 AND 80 AND NOT regexp_matches(z, '{noise.METRIC_VALUE}') AND regexp_matches(x, '{noise.POLICY_HEADING}')""")
def r10_18_promoted_headings(spark: SparkSession, d: str) -> DataFrame:
    """Numbered paragraphs of documents that are taken for headings."""
    return blocks.promoted(noisy(spark, d)).filter("block_type = 'heading'").select("doc_id", "seq", "level")


# The chain's SQL over these blocks: what the rules drop and promote, then the folds and merges as above, where tables are hosts as well.
_policy = rf"block_type IN ('paragraph', 'list') AND length(z) BETWEEN 4 AND 80 AND NOT regexp_matches(z, '{noise.METRIC_VALUE}') AND regexp_matches(x, '{noise.POLICY_HEADING}')"
_renamed = NOISE.replace("b AS (SELECT doc_id, k AS seq", "b0 AS (SELECT doc_id, k AS seq").replace("AS z FROM b)", "AS z FROM b0)")
CHAIN = rf"""{_renamed}, b AS (SELECT doc_id, seq, CASE WHEN {_policy} THEN 'heading' ELSE block_type END AS block_type, page, text, why FROM w),
m AS (SELECT doc_id, seq, block_type, page, text FROM b WHERE block_type <> 'heading' AND why IS NULL AND NOT (block_type = 'paragraph' AND ltrim(text) LIKE '#%' AND contains(left(ltrim(text), 6), ' ')))
{ATT[len(MEAN):].replace("block_type = 'image'", "block_type IN ('image', 'table')")}{CONT[len(ATT):]}{PUB[len(CONT):]}, u AS (SELECT r.*, (SELECT max_by(z.text, z.seq) FROM b z WHERE z.doc_id = r.doc_id AND z.block_type = 'heading' AND z.seq < r.seq) AS heading FROM r)"""


@query(f"""WITH {CHAIN} SELECT {_out.replace("text", "u.text", 1).replace("AS u.text", "AS text")}, attached, n_merged, sha256(heading) AS heading FROM u QUALIFY row_number() OVER (PARTITION BY doc_id, block_type, u.text ORDER BY seq) = 1""")
def r10_18_repacked_all(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain, with every reason to drop a block and numbered paragraphs as headings."""
    rows = blocks.repack_all(noisy(spark, d).withColumn("hint", F.lit(None).cast("string")))
    return rows.select("doc_id", "seq", "block_type", "page", F.sha2("text", 256).alias("text"), F.array_join("attached", "|").alias("attached"), F.size("merged_from").cast("long").alias("n_merged"), F.sha2("heading", 256).alias("heading"))

"""Names, numerals and marks folded, over words and lines of documents that a rule disguises; the SQL folds, or knows, what was there before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions import clean, fold, screens, titles
from siltworks.functions.rules import graph_gate, weak_evidence
from siltworks.operators import governance
from siltworks.queries.lines import SPLIT, split_lines
from siltworks.registry import query
from siltworks.sources.readers import table

ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789().,:%-"
WIDE = "".join(chr(ord(c) + 0xFEE0) for c in ASCII)
FIRST = "regexp_extract(text, '^([^\\x20\\x09-\\x0D]+)', 1)"


def first_word() -> Column:
    return F.coalesce(F.regexp_extract("text", r"^([^\x20\x09-\x0D]+)", 1), F.lit(""))


def loud(word: Column) -> Column:
    """a-z in capitals; other letters may have none of one character."""
    return F.translate(word, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", "text", first_word().alias("word"))


_docs = f"d AS (SELECT doc_id, source, text, coalesce({FIRST}, '') AS word FROM documents)"


@query(f"WITH {_docs} SELECT doc_id, lower(trim(left(text, 200), chr(32) || chr(10) || chr(9) || chr(13))) AS folded FROM d WHERE text IS NOT NULL AND NOT contains(left(text, 200), chr(160))")
def r9_01_wide_texts(spark: SparkSession, d: str) -> DataFrame:
    """Beginnings of texts put into wide characters, whose compatibility form is what they were."""
    rows = documents(spark, d).filter(F.col("text").isNotNull() & ~F.substring("text", 1, 200).contains("\xa0"))
    return rows.select("doc_id", fold.folded(F.translate(F.substring("text", 1, 200), ASCII, WIDE)).alias("folded"))


@query(f"WITH {_docs} SELECT doc_id, sha256(lower(trim(word)) || '|' || lower(trim(coalesce(source, '')))) AS fp FROM d")
def r9_02_wide_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Two spellings of a first word have one fingerprint."""
    wide = F.when(F.col("doc_id") % 2 == 0, F.translate("word", ASCII, WIDE)).otherwise(F.concat(F.lit("　"), loud(F.col("word")), F.lit(" ")))
    return documents(spark, d).select("doc_id", clean.fingerprint(fold.folded(wide), F.col("source")).alias("fp"))


_suffixed = "|".join(sorted(fold.REGION_SUFFIXES, key=len, reverse=True))
_short = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fold.SHORT_FORMS.items())
_tag = "CASE doc_id % 5 WHEN 0 THEN word || '（' || coalesce(source, '') || '）省' WHEN 1 THEN ['京', '粤市', '港 '][doc_id % 3 + 1] WHEN 2 THEN ' ' || word || ' [x(y)] 市' WHEN 3 THEN '县' ELSE word || '自治区{' || word END"


@query(rf"""WITH {_docs}, t AS (SELECT doc_id, translate({_tag}, '（）　', '() ') AS t FROM d), u AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '\([^()]*\)|\[[^\[\]]*\]|\{{[^{{}}]*\}}', '', 'g'), '\([^()]*\)|\[[^\[\]]*\]|\{{[^{{}}]*\}}', '', 'g'), '\s+', '', 'g') AS t FROM t),
v AS (SELECT doc_id, regexp_replace(lower(t), '^(.+?)({_suffixed})$', '\1') AS t FROM u) SELECT doc_id, CASE t {_short} ELSE t END AS tag FROM v""")
def r9_04_disguised_tags(spark: SparkSession, d: str) -> DataFrame:
    """First words of documents as names of regions, with brackets, blanks and endings."""
    doc, word = F.col("doc_id"), F.col("word")
    name = F.when(doc % 5 == 0, F.concat(word, F.lit("（"), F.coalesce("source", F.lit("")), F.lit("）省"))).when(doc % 5 == 1, F.get(F.array(F.lit("京"), F.lit("粤市"), F.lit("港 ")), (doc % 3).cast("int")))
    name = name.when(doc % 5 == 2, F.concat(F.lit(" "), word, F.lit(" [x(y)] 市"))).when(doc % 5 == 3, "县").otherwise(F.concat(word, F.lit("自治区{"), word))
    return documents(spark, d).select("doc_id", fold.tag_value(name, fold.REGION_SUFFIXES).alias("tag"))


def cjk(n: Column) -> Column:
    """A number under 100,000 in CJK digits and units, a zero said once between."""
    digit = lambda k: F.floor(n / 10**k) % 10
    said = lambda k: F.get(F.array(*[F.lit(c) for c in "零一二三四五六七八九"]), digit(k).cast("int"))
    parts = [F.when(digit(k) > 0, F.concat(said(k), F.lit(u))).when((n >= 10 ** (k + 1)) & (digit(k + 1) > 0) & (n % 10**k > 0) & F.lit(k > 0), "零").otherwise("") for k, u in ((4, "万"), (3, "千"), (2, "百"), (1, "十"), (0, ""))]
    return F.concat(*parts)


@query("SELECT doc_id, nullif((doc_id * 37 + coalesce(n_chars, 0)) % 100000, 0)::INT AS n FROM documents")
def r9_29_read_numerals(spark: SparkSession, d: str) -> DataFrame:
    """Numbers written in CJK and read back; a tenth as digits, tens without their one."""
    n = (F.col("doc_id") * 37 + F.coalesce("n_chars", F.lit(0))) % 100000
    said = F.when((n > 0) & (n % 10 == 7), n.cast("string")).when(n.between(10, 19), F.regexp_replace(cjk(n), "^一", "")).otherwise(cjk(n))
    return table(spark, d, "documents").select("doc_id", fold.numeral(said).alias("n"))


_title = "CASE k % 7 WHEN 0 THEN (k // 7 + 1) || '.' || (k % 10) || '.' || (doc_id % 5) || ' ' || line WHEN 1 THEN '第' || '一二三四五六七八九十'[k % 10 + 1] || '章 ' || line WHEN 2 THEN ' Chapter ' || k || ' ' || line WHEN 3 THEN '模块' || (k + 1) || line WHEN 4 THEN (k + 1) || '、' || line WHEN 5 THEN '第 ' || '一二三四五六七八九十'[k % 10 + 1] || ' 节' ELSE line END"


@query(rf"""WITH l AS ({SPLIT}), t AS (SELECT doc_id, k, ltrim({_title}) || ' ' AS t FROM l),
p AS (SELECT *, regexp_extract(t, '^([0-9]+(?:\.[0-9]+){{0,3}})[\s、.\-)]', 1) AS dotted, regexp_extract(t, '^第\s*([一二三四五六七八九十])\s*章', 1) AS chapter, regexp_extract(t, '^第\s*([一二三四五六七八九十])\s*节', 1) AS part, regexp_extract(t, '^(?:项目|模块|单元)\s*([0-9]+)', 1) AS unit,
  regexp_extract(t, '(?i)^Chapter\s+([0-9]+)\b', 1) AS english FROM t)
SELECT doc_id, k::INT AS k, CASE WHEN dotted <> '' THEN dotted WHEN chapter <> '' THEN '第' || chapter || '章' WHEN part <> '' THEN '第' || part || '节' WHEN unit <> '' THEN unit WHEN english <> '' THEN 'Chapter ' || english END AS token,
  CASE WHEN dotted <> '' THEN array_to_string(list_transform(string_split(dotted, '.'), lambda x: TRY_CAST(x AS INT)), '/') WHEN chapter <> '' THEN instr('一二三四五六七八九十', chapter)::VARCHAR WHEN part <> '' THEN instr('一二三四五六七八九十', part)::VARCHAR
  WHEN unit <> '' THEN TRY_CAST(unit AS INT)::VARCHAR WHEN english <> '' THEN TRY_CAST(english AS INT)::VARCHAR ELSE '' END AS path FROM p""")
def r9_30_line_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of headings made of lines of documents."""
    k, line = F.col("k"), F.col("line")
    digit, text = F.substr(F.lit("一二三四五六七八九十"), (k % 10 + 1).cast("int"), F.lit(1)), lambda x: x.cast("string")
    title = F.when(k % 7 == 0, F.concat(text(F.floor(k / 7) + 1), F.lit("."), text(k % 10), F.lit("."), text(F.col("doc_id") % 5), F.lit(" "), line)).when(k % 7 == 1, F.concat(F.lit("第"), digit, F.lit("章 "), line))
    title = title.when(k % 7 == 2, F.concat(F.lit(" Chapter "), text(k), F.lit(" "), line)).when(k % 7 == 3, F.concat(F.lit("模块"), text(k + 1), line)).when(k % 7 == 4, F.concat(text(k + 1), F.lit("、"), line)).when(k % 7 == 5, F.concat(F.lit("第 "), digit, F.lit(" 节"))).otherwise(line)
    rows = split_lines(spark, d).select("doc_id", "k", fold.heading_number(title).alias("h"))
    return rows.select("doc_id", "k", "h.token", F.coalesce(F.array_join(F.col("h.path").cast("array<string>"), "/"), F.lit("")).alias("path"))


_name = "CASE doc_id % 6 WHEN 0 THEN '我国' WHEN 1 THEN ' 第三章  ' || word || ' （上）' WHEN 2 THEN '项目 二 ' || word WHEN 3 THEN '任务' || (doc_id % 90) || '　' || word WHEN 4 THEN '国内' ELSE word || '：％' END"


@query(rf"""WITH {_docs}, t AS (SELECT doc_id, trim(regexp_replace(translate({_name}, '{screens.WIDE}', '{screens.NARROW}'), '\s+', ' ', 'g')) AS t FROM d),
u AS (SELECT doc_id, regexp_replace(regexp_replace(t, '^(第[一二三四五六七八九十百\d]+[章节篇])\s+', '\1'), '^(项目|任务|模块)\s*([一二三四五六七八九十\d]+)\s+', '\1\2') AS t FROM t)
SELECT doc_id, CASE t {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in screens.ENTITY_NAMES.items())} ELSE t END AS name FROM u""")
def r9_31_disguised_entities(spark: SparkSession, d: str) -> DataFrame:
    """First words of documents as names of chapters, tasks and the country."""
    doc, word = F.col("doc_id"), F.col("word")
    name = F.when(doc % 6 == 0, "我国").when(doc % 6 == 1, F.concat(F.lit(" 第三章  "), word, F.lit(" （上）"))).when(doc % 6 == 2, F.concat(F.lit("项目 二 "), word))
    name = name.when(doc % 6 == 3, F.concat(F.lit("任务"), (doc % 90).cast("string"), F.lit("　"), word)).when(doc % 6 == 4, "国内").otherwise(F.concat(word, F.lit("：％")))
    return documents(spark, d).select("doc_id", screens.entity_name(name).alias("name"))


@query(f"WITH {_docs} SELECT doc_id, CASE WHEN word <> '' AND doc_id % 3 < 2 THEN lower(word) END AS field FROM d")
def r9_37_header_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Headers, wide or in capitals, looked up by a map of every name to what it stands for."""
    doc, word = F.col("doc_id"), F.col("word")
    header = F.when(doc % 3 == 0, F.concat(F.translate(word, ASCII, WIDE), F.lit(" "))).when(doc % 3 == 1, loud(word)).otherwise("no header")
    names = F.map_from_arrays(F.array(F.lower(word), F.lit("unit")), F.array(F.lower(word), F.lit("x")))
    return documents(spark, d).filter("lower(word) <> 'unit'").select("doc_id", F.when(F.col("word") != "", F.try_element_at(names, fold.folded(header))).alias("field"))


_major = "CASE doc_id % 6 WHEN 0 THEN word || '专业教学标准' WHEN 1 THEN ' ' || word || ' 中等职业教育专业教学标准 ' WHEN 2 THEN word || '类' WHEN 3 THEN word || '大类' WHEN 4 THEN word || '教学标准教学标准教学标准' ELSE '能力分析表' END"
_ending = "(?:" + "|".join(sorted(fold.MAJOR_SUFFIXES, key=len, reverse=True)) + ")$"


@query(rf"""WITH {_docs}, t AS (SELECT doc_id, trim(regexp_replace(trim(regexp_replace(trim({_major}), '{_ending}', '')), '{_ending}', '')) AS t FROM d)
SELECT doc_id, nullif(trim(CASE WHEN t LIKE '%类' AND t NOT LIKE '%大类' THEN left(t, length(t) - 1) ELSE t END), '') AS major FROM t""")
def r11_05_titled_majors(spark: SparkSession, d: str) -> DataFrame:
    """First words of documents as majors, with what kind of paper they head."""
    doc, word = F.col("doc_id"), F.col("word")
    name = F.when(doc % 6 == 0, F.concat(word, F.lit("专业教学标准"))).when(doc % 6 == 1, F.concat(F.lit(" "), word, F.lit(" 中等职业教育专业教学标准 "))).when(doc % 6 == 2, F.concat(word, F.lit("类")))
    name = name.when(doc % 6 == 3, F.concat(word, F.lit("大类"))).when(doc % 6 == 4, F.concat(word, F.lit("教学标准教学标准教学标准"))).otherwise("能力分析表")
    return documents(spark, d).select("doc_id", fold.major_name(name).alias("major"))


_marks = {2: "请扫码关注我们", 3: "> This figure is a Logo", 4: "> The image is a QR code.", 5: "共 12000+份行业研究报告", 6: "x\n 关注公众号 \ny", 7: "长按识别关注公众号"}
_marked = "CASE k % 10 " + " ".join("WHEN {} THEN '{}'".format(k, v.replace("\n", "' || chr(10) || '")) for k, v in _marks.items()) + " ELSE line END"
_any = lambda patterns: " OR ".join(f"regexp_matches(t, '{p}')" for p in patterns)


@query(f"""WITH l AS ({SPLIT}), t AS (SELECT doc_id, k, CASE WHEN k % 4 = 1 THEN 'text' WHEN k % 4 = 3 THEN 'chart' ELSE 'image' END AS kind, {_marked} AS t FROM l)
SELECT doc_id, CASE WHEN {_any(screens.WATERMARKS)} THEN 'watermark_text' WHEN kind <> 'text' AND ({_any(screens.DECORATIONS)}) THEN 'decorative_image_vlm' END AS reason, count(*) AS n, sum(k)::BIGINT AS mark FROM t GROUP BY ALL""")
def r10_04_marked_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as blocks, some of them watermarks and decorations."""
    k, text = F.col("k"), F.col("line")
    for n, said in _marks.items():
        text = F.when(k % 10 == n, said).otherwise(text)
    kind = F.when(k % 4 == 1, "text").when(k % 4 == 3, "chart").otherwise("image")
    rows = split_lines(spark, d).select("doc_id", "k", screens.noise_reason(kind, text).alias("reason"))
    return rows.groupBy("doc_id", "reason").agg(F.count("*").alias("n"), F.sum("k").alias("mark"))


@query(r"""WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM conversations),
p AS (SELECT a.conv_id, a.n, a.t AS question, b.t AS answer FROM c a JOIN c b ON b.conv_id = a.conv_id AND b.n = a.n + 1 WHERE a.n % 2 = 1 AND length(a.t) > 0 AND length(b.t) > 0)
SELECT conv_id, count(*) AS n, sha256(string_agg(question || '=' || answer, ';' ORDER BY n)) AS pairs FROM p WHERE length(question) >= 5 AND length(answer) >= 10 GROUP BY conv_id""")
def r10_21_conversation_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as one text of questions and answers, and the pairs read out of it."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    said = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    rows = table(spark, d, "conversations").select("conv_id", F.row_number().over(w).alias("n"), said.alias("t"))
    both = rows.withColumn("next", F.lead("t").over(Window.partitionBy("conv_id").orderBy("n"))).filter("n % 2 = 1 and length(t) > 0 and length(next) > 0")
    texts = both.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "t", "next"))).alias("x"))
    text = F.array_join(F.transform("x", lambda x: F.concat(F.lit("Q: "), x["t"], F.lit("\nA: "), x["next"])), "\n")
    pairs = texts.select("conv_id", titles.qa_pairs(text).alias("p")).filter(F.size("p") > 0)
    return pairs.select("conv_id", F.size("p").cast("long").alias("n"), F.sha2(F.array_join(F.transform("p", lambda p: F.concat(p["question"], F.lit("="), p["answer"])), ";"), 256).alias("pairs"))


_weak = "CASE k % 6 WHEN 0 THEN ' 目录 ' || line WHEN 1 THEN '知识回顾：' || line WHEN 2 THEN left(line, 4) || ' 目录' WHEN 3 THEN '目 录' ELSE line END"


@query(rf"""WITH l AS ({SPLIT}), t AS (SELECT doc_id, k, trim({_weak}) AS t, k % 5 = 4 AS goal FROM l)
SELECT doc_id, count(*) FILTER (goal OR starts_with(t, '目录') OR starts_with(t, '目 录') OR starts_with(t, '知识回顾')) AS n_weak, count(*) AS n FROM t GROUP BY doc_id""")
def r8_27_weak_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents that name goals or contents and answer nothing."""
    k = F.col("k")
    rows = split_lines(spark, d).select("doc_id", weak_evidence(F.when(k % 5 == 4, F.concat(F.lit("学习目标 "), F.substring("line", 1, 5))), F.expr(_weak)).alias("weak"))
    return rows.groupBy("doc_id").agg(F.count_if("weak").alias("n_weak"), F.count("*").alias("n"))


_caption = "CASE k % 4 WHEN 0 THEN '登录界面 ' || left(line, 5) WHEN 1 THEN '流程图' WHEN 2 THEN NULL ELSE left(line, 12) END"
_shown = "CASE k % 7 WHEN 0 THEN '- ' || left(line, 6) || chr(10) || '* b' || chr(10) || '•c' WHEN 1 THEN '密码 保存 取消 确定 ' || line || ' 点击' WHEN 2 THEN '<label>' || line || '<LABEL>' WHEN 3 THEN line || ' 密码' WHEN 4 THEN '- ' || line ELSE line END"
_words = lambda x: f"len(regexp_extract_all({x}, '{screens.SCREEN_WORD}'))"


@query(rf"""WITH l AS ({SPLIT}), c AS (SELECT doc_id, trim(coalesce({_caption}, '')) AS c, trim({_shown}) AS t FROM l), b AS (SELECT doc_id, c, t, CASE WHEN c = '' THEN t ELSE c || chr(10) || t END AS b FROM c),
n AS (SELECT doc_id, c, {_words("b")} AS words, len(regexp_extract_all(b, '(?i)<label>')) AS labels, len(list_filter(string_split(b, chr(10)), lambda x: regexp_matches(trim(x), '^[-*•]') AND length(trim(x)) <= 24)) AS controls, regexp_matches(c, '{screens.SCREEN_CAPTION}') AS named FROM b)
SELECT doc_id, count(*) FILTER (NOT regexp_matches(c, '{screens.KNOWLEDGE_CAPTION}') AND ((named AND (words >= 2 OR labels >= 1 OR controls >= 3)) OR labels >= 2 OR words >= 5)) AS n_screens, count(*) AS n FROM n GROUP BY doc_id""")
def r11_09_screens_in_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as texts of pictures, some of them controls of a screen."""
    expr = lambda v: F.expr(v.replace("chr(10)", "'\\n'"))
    rows = split_lines(spark, d).select("doc_id", screens.is_screenshot(expr(_caption), expr(_shown)).alias("screen"))
    return rows.groupBy("doc_id").agg(F.count_if("screen").alias("n_screens"), F.count("*").alias("n"))


@query("""WITH g AS (SELECT l_orderkey, count(*) AS kept, count(*) FILTER (l_returnflag = 'R') AS facts, count(*) FILTER (l_linestatus = 'F') AS links, avg((l_quantity < 45)::INT) AS single, avg((l_discount > 0.09)::INT) AS multi, avg((l_tax > 0.05)::INT) AS gen,
  count(*) / count(DISTINCT l_suppkey % 3) AS per FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_filter([CASE WHEN kept >= 3 AND links = 0 THEN 'no_chunk_context_links' END, CASE WHEN kept >= 5 AND single > 0.9 AND per > 1.5 THEN 'over_localized_single_chunk_graph' END, CASE WHEN kept >= 3 AND gen > 0.3 THEN 'generic_entity_ratio_high' END,
CASE WHEN kept >= 5 AND multi < 0.1 THEN 'multi_chunk_context_low' END], lambda x: x IS NOT NULL), ',') AS warnings, facts = 0 AS blocked FROM g""")
def r11_13_gate_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """The gate over figures counted from the lines of each order."""
    share = lambda c: F.avg(F.expr(c).cast("int"))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("kept"),
        F.count_if(F.col("l_returnflag") == "R").alias("facts"),
        F.count_if(F.col("l_linestatus") == "F").alias("links"),
        share("l_quantity < 45").alias("single"),
        share("l_discount > 0.09").alias("multi"),
        share("l_tax > 0.05").alias("gen"),
        (F.count("*") / F.count_distinct(F.col("l_suppkey") % 3)).alias("per"),
    )
    warnings, blockers = graph_gate(*[F.col(c) for c in ("kept", "facts", "links", "single", "multi", "gen", "per")])
    return g.select("l_orderkey", F.array_join(warnings, ",").alias("warnings"), (F.size(blockers) > 0).alias("blocked"))


_told = [w for words, _ in governance.CO_EMISSIONS.values() for w in list(words)[:1]]
_topic = "CASE k % 11 " + " ".join(f"WHEN {n} THEN left(line, 10) || ' {w.upper()} ' || line" for n, w in enumerate(_told)) + " ELSE line END"
_sure = ", ".join(f"round(avg(CASE WHEN {' OR '.join(f'''contains(t, '{w}')''' for w in words)} THEN {sure} ELSE 0.3 END::DOUBLE), 6) AS c{n}" for n, (words, sure) in enumerate(governance.CO_EMISSIONS.values()))


@query(f"WITH l AS ({SPLIT}), t AS (SELECT doc_id, lower({_topic}) AS t FROM l) SELECT doc_id, {_sure} FROM t GROUP BY doc_id")
def r12_10_emissions_of_lines(spark: SparkSession, d: str) -> DataFrame:
    """Mean confidence, over a document's lines, that each further kind of knowledge is to be made."""
    rows = split_lines(spark, d).select("doc_id", F.expr(_topic).alias("t"))
    return rows.groupBy("doc_id").agg(*[F.round(F.avg(governance.co_emission(c, F.col("t"))), 6).alias(f"c{n}") for n, c in enumerate(governance.CO_EMISSIONS)])

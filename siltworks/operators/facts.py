"""Chunks chosen for facts, facts read from rows and figures by rule, and what validation refuses.

Defined cases: null texts are empty; a chunk without a fact has a reason instead; null confidence, a blank subject or predicate, a missing object and texts that are too
long are refused as ``schema_invalid``; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions.screens import is_screenshot

#: What a record is named after, figures, units and what they come to, roles of pictures, roles of chunks.
SUBJECTS = ["文件名", "政策", "标准", "对象", "部门"]
RECORD = "表格行记录"
METRIC = r"([\x{4e00}-\x{9fa5}A-Za-z0-9（）()·_\- ]{2,40}?)(?:同比|环比|增长|为|达到|达|占比|比重|数值)?[:： ]+([-+]?\d+(?:\.\d+)?\s*(?:%|％|万亿元|亿元|万元|人|个|项|倍)?)"
UNITS = {"%": (0.01, ""), "％": (0.01, ""), "万亿元": (1e12, "元"), "亿元": (1e8, "元"), "万元": (1e4, "元"), "人": (1.0, "人"), "个": (1.0, "个"), "项": (1.0, "项"), "倍": (1.0, "倍")}
PICTURE_ROLES = ["decorative", "logo", "qr", "qrcode", "screenshot", "screen", "ui", "interface", "software_screenshot", "platform_screenshot"]
PICTURE_TEXTS = ["qr", "qrcode", "logo", "about us", "目录"]
ACCEPTED = ["body", "metric_image", "table_row", "chart", "image"]
SKIPPED = ["table_overview"]
#: Most characters of evidence, literals, names, types and predicates; confidence by kind of chunk.
LONGEST = {"evidence_text": 4096, "object_literal": 2048, "subject_name": 512, "fact_type": 64, "predicate": 128}
CONFIDENCE = {"table_row": 0.78, "metric_image": 0.82, "chart": 0.78}
HAN = r"[\x{4e00}-\x{9fff}]"
SENTENCE = r"[^。！？!?；;\n]*[。！？!?；;\n]+|[^。！？!?；;\n]+"

_bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
_lines = lambda x: F.split(F.coalesce(x, F.lit("")), r"\r\n|\r|\n")


def skip_reason(accepted: list[str] = ACCEPTED, skipped: list[str] = SKIPPED) -> Column:
    """Why a chunk (content, chunk_type, and metadata: anchor_role, graph_candidate, profile, domain_model, low_quality, image_role, caption) is no candidate; null for one that is.

    The first reason of empty_content, task_outline_not_graph_candidate, missing_anchor_role, skipped_anchor_role, unsupported_anchor_role,
    low_quality_chunk and non_semantic_image.
    """
    meta = lambda c: F.coalesce(F.col(f"metadata.{c}"), F.lit(""))
    role = F.coalesce(F.nullif(F.col("metadata.anchor_role"), F.lit("")), F.when(F.col("chunk_type") == "process_step", "body"), F.lit(""))
    outline = (meta("graph_candidate") == "false") | (meta("profile") == "task_outline") | (meta("domain_model") == "task_outline.v1")
    low = F.coalesce(F.col("metadata.low_quality"), F.lit(False)) | (meta("graph_candidate") == "skip")
    text = _bare(F.coalesce("content", F.lit("")))
    picture = F.lower(meta("image_role")).isin(PICTURE_ROLES) | F.lower(text).isin(PICTURE_TEXTS) | is_screenshot(meta("caption"), text)
    why = F.when(text == "", "empty_content").when(outline, "task_outline_not_graph_candidate").when(role == "", "missing_anchor_role").when(role.isin(skipped), "skipped_anchor_role")
    return why.when(~role.isin(accepted), "unsupported_anchor_role").when(low, "low_quality_chunk").when((role == "image") & picture, "non_semantic_image")


def key_values(text: Column) -> Column:
    """array<struct<key, value>> of the lines ``key: value``; a key keeps its first place and its last value."""
    line = F.transform(_lines(text), lambda x: F.regexp_replace(x, r"^[ \t|]+|[ \t|]+$", ""))
    part = lambda x, k: F.when(x.contains(":"), F.regexp_extract(x, "^([^:]*):(.*)$", k)).otherwise(F.regexp_extract(x, "^([^：]*)：(.*)$", k))
    pairs = F.filter(F.transform(line, lambda x: F.struct(_bare(part(x, 1)).alias("key"), _bare(part(x, 2)).alias("value"))), lambda p: (p["key"] != "") & (p["value"] != ""))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"].alias("value")))


def first_metric(text: Column) -> Column:
    """struct<name, value> of the first line of a text that states a figure; null without one."""
    # The cheap test, which every figure passes, spares most lines the dear one.
    found = F.filter(F.transform(_lines(text), _bare), lambda x: x.rlike(r"[:： ][-+]?\d") & x.rlike(METRIC))
    line = F.get(found, F.lit(0))
    part = lambda k: _bare(F.regexp_extract(line, METRIC, k))
    return F.when(line.isNotNull(), F.struct(part(1).alias("name"), part(2).alias("value")))


def normal_value(value: Column) -> Column:
    """struct<number, unit> of a figure with its unit: amounts in 元, percentages as shares."""
    number, unit = F.regexp_extract(value, r"^([-+]?\d+(?:\.\d+)?)", 1).try_cast("double"), _bare(F.regexp_replace(value, r"^[-+]?\d+(?:\.\d+)?", ""))
    times, base = F.lit(1.0), F.lit("")
    for name, (factor, plain) in UNITS.items():
        times, base = F.when(unit == name, factor).otherwise(times), F.when(unit == name, plain).otherwise(base)
    return F.when(number.isNotNull(), F.struct((number * times).alias("number"), base.alias("unit")))


def sentences(texts: DataFrame, key: str, text: str) -> DataFrame:
    """row, key, n, sentence, start, end (code points): a text cut after its marks of an end and line breaks; together the sentences are the text."""
    own = texts.select(F.monotonically_increasing_id().alias("row"), key, F.coalesce(F.col(text), F.lit("")).alias("said"))
    parts = own.select("row", key, F.regexp_extract_all("said", F.lit(SENTENCE), F.lit(0)).alias("parts"))
    ends = F.aggregate(F.transform("parts", F.length), F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
    rows = parts.select("row", key, F.posexplode(F.arrays_zip(F.col("parts").alias("sentence"), F.slice(ends, F.lit(1), F.size("parts")).alias("start"))).alias("n", "x"))
    return rows.select("row", key, "n", "x.sentence", "x.start", (F.col("x.start") + F.length("x.sentence")).alias("end"))


def extract(chunks: DataFrame, standard: bool = False) -> DataFrame:
    """Chunks (role, content) with a fact read by rule: ``reason`` (null if there is one), fact_type, subject_type, subject_name, predicate, object_literal, evidence_text, confidence."""
    fields, metric = F.col("fields_"), F.col("metric_")
    row, figure = F.coalesce(F.col("role") == "table_row", F.lit(False)), F.coalesce(F.col("role").isin("metric_image", "chart"), F.lit(False))
    read = chunks.withColumn("fields_", F.when(row, key_values(F.col("content")))).withColumn("metric_", F.when(figure, first_metric(F.col("content"))))
    reason = F.when(~row & ~figure, "unsupported_extractor").when(row & (F.size(fields) == 0), "no_fact_candidate").when(figure & metric.isNull(), "no_fact_candidate")
    given = lambda key: F.get(F.filter(fields, lambda p: p["key"] == key), F.lit(0))["value"]
    named = F.coalesce(*[given(k) for k in SUBJECTS], F.lit(RECORD))
    literal = F.array_join(F.transform(fields, lambda p: F.concat(p["key"], F.lit(": "), p["value"])), "; ")
    known = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    fact = {
        "fact_type": F.when(figure, "metric_fact").otherwise("standard_issue_fact" if standard else "policy_fact"),
        "subject_type": F.when(figure, "Metric").otherwise("Record"),
        "subject_name": F.when(figure, metric["name"]).otherwise(named),
        "predicate": F.when(figure, "HAS_VALUE").otherwise("HAS_TABLE_ROW_FACT"),
        "object_literal": F.when(figure, metric["value"]).otherwise(literal),
        "evidence_text": F.col("content"),
        "confidence": F.try_element_at(known, F.col("role")),
    }
    return read.withColumn("reason", reason).select(*chunks.columns, "reason", *[F.when(F.col("reason").isNull(), v).alias(c) for c, v in fact.items()])


def _foreign(value: Column, source: Column) -> Column:
    """Whether a text is an English phrase that its source, which isn't English, doesn't hold."""
    text = F.trim(F.coalesce(value, F.lit("")))
    plain = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")
    phrase = (F.regexp_count(text, F.lit("[A-Za-z]{2,}")) >= 2) | ((F.length(text) >= 16) & text.contains(" "))
    return (text != "") & ~text.rlike(HAN) & text.rlike("[A-Za-z]{2,}") & ~F.contains(plain(source), plain(text)) & phrase


def validated(facts: DataFrame, source: str) -> DataFrame:
    """Facts (as of ``extract``, or another's) with ``refused``: the reason of extraction, ``language_mismatch``, ``schema_invalid``, or null. ``source`` is the column of the text that a fact is from."""
    text = F.coalesce(F.col(source), F.lit(""))
    evidence = F.coalesce("evidence_text", F.lit(""))
    mismatch = text.rlike(HAN) & (((evidence != "") & ~evidence.rlike(HAN)) | _foreign(F.col("object_literal"), text) | _foreign(F.col("subject_name"), text))
    wrong = ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))
    for c, most in LONGEST.items():
        said = F.coalesce(F.col(c), F.lit(""))
        wrong = wrong | (F.length(said) > most) | (_bare(said) == "")
    reason = F.col("reason") if "reason" in facts.columns else F.lit(None).cast("string")
    return facts.withColumn("refused", F.when(reason.isNotNull(), reason).when(mismatch, "language_mismatch").when(wrong, "schema_invalid"))


def summary(facts: DataFrame, *keys: str) -> DataFrame:
    """keys, n_accepted, n_refused, and how many were refused for each reason, as a map: one aggregate over (keys, reason), one over keys."""
    counts = facts.groupBy(*keys, "refused").agg(F.count("*").alias("n"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    why = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("refused").isNotNull(), F.struct("refused", "n")))))
    return counts.groupBy(*keys).agg(total(F.col("refused").isNull()).alias("n_accepted"), total(F.col("refused").isNotNull()).alias("n_refused"), why.alias("reasons"))

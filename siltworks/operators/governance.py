"""Governance of extracted facts, decisions on suggestions, admission, routing and section keys.

All are Column expressions but ``govern``, which has one window, and ``subject``, one grouped
aggregate.  A null in a column counts as absent unless a docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Types, predicates, names and roles of facts.
CORE_TYPES = [
    "clause_requirement_fact", "definition_fact", "dependency_fact", "event_fact", "finding_fact", "formula_fact",
    "metric_fact", "method_step_fact", "obligation_fact", "policy_fact", "policy_issue_fact", "procedure_fact",
    "requirement_fact", "risk_control_fact", "scope_fact", "standard_issue_fact", "step_fact", "trend_fact",
]
LOW_TYPES = ["entity_mention", "example_fact"]
WEAK_PREDICATES = ["MENTIONS", "提到", "涉及"]
STRONG_PREDICATES = [
    "AFFECTS", "APPLIES_TO", "CONTAINS", "DEFINES", "DEPENDS_ON", "EFFECTIVE_AT", "EXPLAINS", "HAS_CONDITION",
    "HAS_EXCEPTION", "HAS_GROWTH_RATE", "HAS_PROPERTY", "HAS_STEP", "HAS_VALUE", "ISSUED_BY", "PRECEDES",
    "PROHIBITS", "REQUIRES", "SUPPORTED_BY", "SUPPORTS", "USES_FORMULA",
]
GENERIC_NAMES = ["实体", "内容", "对象", "事项", "主题", "信息", "文本"]
ROLES = [
    "definition", "requirement", "metric_context", "finding", "trend", "policy_context",
    "dependency", "method", "procedure", "section_topic", "supporting_evidence",
]
#: Co-emission conditions: keywords and the confidence if one is there.
CO_EMISSIONS = {
    "contains_qa_pairs": (["问答", "q&a", "问题", "答案"], 0.7),
    "contains_concept_relations": (["概念", "关系", "知识图谱", "依赖", "职业面向", "培养目标", "培养规格", "课程设置", "课程体系", "岗位", "能力要求"], 0.75),
    "contains_process_steps": (["步骤", "流程", "操作", "指南"], 0.7),
    "contains_indicators": (["指标", "kpi", "考核", "评估"], 0.7),
    "contains_case_studies": (["案例", "实例", "场景"], 0.7),
    "contains_skill_taxonomy": (["技能点", "技能要求", "能力点", "技能等级", "技能标签"], 0.75),
    "contains_competency_breakdown": (["能力分解", "能力图谱", "岗位能力", "职业能力", "胜任力"], 0.75),
}
ADOPTED = ["auto_adopted", "human_confirmed", "human_overridden"]
SHEET_TYPES = ["application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.ms-excel"]
CSV_TYPES = ["text/csv"]
PAGE_TYPES = ["text/html", "application/xhtml+xml", "text/markdown", "application/pdf"]


def _one_of(x: Column, values: Iterable[str]) -> Column:
    return F.coalesce(x.isin(list(values)), F.lit(False))


def _bonus(when: Column, points: float) -> Column:
    return F.when(when, F.lit(points)).otherwise(F.lit(0.0))


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _filled(x: str) -> Column:
    return F.coalesce(F.filter(x, lambda e: F.trim(e) != ""), F.array().cast("array<string>"))


def _predicate() -> Column:
    return F.upper(F.trim(F.coalesce("predicate", F.lit(""))))


def _evidence() -> Column:
    """The source first, then the rest, each once."""
    source = F.when(F.coalesce("source_chunk", F.lit("")) != "", F.array("source_chunk")).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(source, _filled("evidence")))


def _generic() -> Column:
    return _one_of(F.trim("subject"), GENERIC_NAMES) | _one_of(F.trim("object"), GENERIC_NAMES)


def salience() -> Column:
    """How much a fact says, 0 to 1; see ``govern`` for the columns.  A null confidence counts as 0."""
    literal = F.length(F.trim(F.coalesce("object_literal", F.lit(""))))
    sure = _unit(F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)))
    score = (
        F.lit(0.25)
        + _bonus(_one_of(F.col("fact_type"), CORE_TYPES), 0.24)
        + _bonus(_one_of(F.col("fact_type"), LOW_TYPES), -0.18)
        + _bonus(_one_of(_predicate(), STRONG_PREDICATES), 0.18)
        + _bonus(_one_of(_predicate(), WEAK_PREDICATES), -0.16)
        + _bonus(F.col("object").isNotNull(), 0.08)
        + F.least(F.lit(0.16), literal / 500)
        + _bonus(F.size(_evidence()) > 1, 0.18)
        + _bonus(F.size(_filled("context_for")) > 0, 0.12)
        + _bonus(_one_of(F.trim("context_role"), ROLES), 0.08)
        + (sure - 0.7) * 0.18
        + _bonus(_generic(), -0.18)
    )
    return F.round(_unit(score), 4)


def context_role() -> Column:
    """The role that a fact names, if it is one of ``ROLES``, else by type and predicate."""
    kind, does = F.col("fact_type"), _predicate()
    return (
        F.when(_one_of(F.trim("context_role"), ROLES), F.trim("context_role"))
        .when(_one_of(kind, ["definition_fact"]) | (does == "DEFINES"), "definition")
        .when(_one_of(kind, ["requirement_fact", "obligation_fact", "clause_requirement_fact"]), "requirement")
        .when(_one_of(kind, ["metric_fact"]) | does.isin("HAS_VALUE", "HAS_GROWTH_RATE"), "metric_context")
        .when(_one_of(kind, ["trend_fact"]), "trend")
        .when(_one_of(kind, ["finding_fact"]), "finding")
        .when(_one_of(kind, ["policy_fact", "policy_issue_fact"]), "policy_context")
        .when(_one_of(kind, ["dependency_fact"]) | (does == "DEPENDS_ON"), "dependency")
        .when(_one_of(kind, ["method_step_fact"]), "method")
        .when(_one_of(kind, ["procedure_fact", "step_fact"]), "procedure")
        .otherwise("supporting_evidence")
    )


def govern(facts: DataFrame, order: str, least: float = 0.45, most: int = 8) -> DataFrame:
    """Adds ``salience``, ``role``, ``priority`` and ``rejected``: why a fact goes, null for those that stay.

    Columns of facts: fact_type, predicate, subject, object, object_literal, source_chunk,
    evidence and context_for (arrays of chunk ids), context_role, confidence.  ``order`` is
    unique in a source chunk.  As each fact that passes the other rules is kept until a chunk
    has ``most``, the rule on full chunks is a running count, not a fold.
    """
    if most <= 0:
        raise ValueError("a chunk must be allowed a fact")
    points, role, seen = salience(), context_role(), F.size(_evidence())
    reason = (
        F.when(_generic() & (points < 0.75), "generic_entity")
        .when(_one_of(F.col("fact_type"), LOW_TYPES) & _one_of(_predicate(), WEAK_PREDICATES) & (seen <= 1) & (role == "supporting_evidence"), "weak_local_mention")
        .when(points < least, "low_salience")
    )
    before = Window.partitionBy("source_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    full = (F.count(F.when(reason.isNull(), 1)).over(before) >= most) & (seen <= 1)
    helps = F.size(F.array_distinct(F.when(F.size(_filled("context_for")) > 0, _filled("context_for")).when(seen > 1, _evidence()).otherwise(F.array().cast("array<string>"))))
    priority = F.round(_unit(points + _bonus(helps > 1, 0.08) + _bonus(seen > 1, 0.06)), 4)
    return facts.select("*", points.alias("salience"), role.alias("role"), priority.alias("priority"), F.coalesce(reason, F.when(full, "per_chunk_overrun")).alias("rejected"))


def decision(field: str, value: Column, confidence: Column, threshold: float, known: Iterable[str] | None = None) -> Column:
    """struct(field, value, status, reason): adopted if sure enough and, where ``known`` is given, one of it; a null confidence counts as 0."""
    sure = F.coalesce(confidence.cast("double"), F.lit(0.0))
    reason = F.when(sure < threshold, F.concat(F.lit("confidence "), F.format_string("%.2f", sure), F.lit(f" < threshold {threshold}")))
    if known is not None:
        reason = reason.when(~_one_of(value, known), F.concat(F.lit(f"{field} '"), F.coalesce(value, F.lit("")), F.lit("' not in valid set")))
    return F.struct(F.lit(field).alias("field"), value.alias("value"), F.when(reason.isNull(), "auto_adopted").otherwise("review_required").alias("status"), reason.alias("reason"))


def admitted(status: Column, admission: Column, level: Column, trail: Column) -> Column:
    """Whether a result is available, admitted, passes, and each status of its trail is final; a null trail is empty, a null status isn't final."""
    final = F.coalesce(F.forall(trail, lambda s: _one_of(s, ADOPTED)), F.lit(True))
    return _one_of(status, ["available"]) & F.coalesce(admission, F.lit(False)) & _one_of(level, ["pass"]) & final


def co_emission(condition: str, *texts: Column) -> Column:
    """Confidence that a further kind of knowledge is to be made from the texts; 0 for an unknown condition."""
    if condition not in CO_EMISSIONS:
        return F.lit(0.0)
    words, sure = CO_EMISSIONS[condition]
    low = [F.lower(F.coalesce(t, F.lit(""))) for t in texts]
    found = F.lit(False)
    for t in low:
        for w in words:
            found = found | t.contains(w)
    return F.when(found, sure).otherwise(0.3)


def route(source: Column, mime: Column, sheets: bool = False, csv: bool = False, pages: Iterable[str] = PAGE_TYPES) -> Column:
    """'document' or 'record' by kind of source and MIME type, in any case; unknown sources go by their type alone."""
    kind = F.lower(F.coalesce(mime, F.lit("")))
    tables = [*(SHEET_TYPES if sheets else []), *(CSV_TYPES if csv else [])]
    chain = F.when(_one_of(source, ["crawler"]) & kind.isin(list(pages)), "document").when(_one_of(source, ["crawler", "database", "webhook"]) | kind.contains("json"), "record")
    return (chain.when(kind.isin(tables), "record") if tables else chain).otherwise("document")


def subject_key(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"[\s，,。.．:：、]", ""))


def subject(entities: DataFrame, question: str) -> DataFrame:
    """One row (kind, name): the longest name of ``entities`` (kind, name) that the question holds.

    Keys of under two characters don't count; two kinds with equally long names give
    'ambiguous', none gives 'unknown', both without a name.
    """
    asked = subject_key(F.lit(question))
    held = entities.select("kind", F.trim("name").alias("name")).select("*", subject_key(F.col("name")).alias("k")).filter((F.length("k") >= 2) & asked.contains(F.col("k")))
    best = held.groupBy("kind").agg(F.min(F.struct((-F.length("k")).alias("n"), "name")).alias("b"))
    # One row for each kind.
    one = best.agg(F.min(F.struct("b.n", "kind", "b.name")).alias("m"), F.sort_array(F.collect_list("b.n")).alias("ns"))
    tie = (F.size("ns") > 1) & (F.get("ns", F.lit(0)) == F.get("ns", F.lit(1)))
    return one.select(F.when(F.size("ns") == 0, "unknown").when(tie, "ambiguous").otherwise(F.col("m.kind")).alias("kind"), F.when((F.size("ns") > 0) & ~tie, F.col("m.name")).alias("name"))


def section_key(ref: Column, path: Column, section: Column, blocks: Column) -> Column:
    """24 hex digits of the canonical JSON of a section (path: array<struct<level, title>>); null if it has no path, id or blocks."""
    size = lambda x: F.coalesce(F.size(x), F.lit(0))
    none = (size(path) <= 0) & (F.coalesce(section, F.lit("")) == "") & (size(blocks) <= 0)
    text = F.to_json(F.struct(path.alias("heading_path"), ref.alias("normalized_ref_id"), section.alias("section_id"), blocks.alias("source_block_ids")), {"ignoreNullFields": "false"})
    return F.when(~none, F.substring(F.sha2(text, 256), 1, 24))


def profile(candidates: dict[str, Column], threshold: float, other: str = "generic_table_dataset") -> Column:
    """The name with the highest confidence, the first of equals; below ``threshold`` a '_candidate', without any above 0 ``other``."""
    sure = {k: F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in candidates.items()}
    best = F.greatest(*sure.values()) if len(sure) > 1 else next(iter(sure.values()))
    name = F.coalesce(*[F.when(c == best, F.lit(k)) for k, c in sure.items()])
    return F.when(best <= 0, other).when(best < threshold, F.concat(name, F.lit("_candidate"))).otherwise(name)

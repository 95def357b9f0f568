"""The ten rules on analyses of abilities, as tables of findings.

Rules on an ability are read in one pass over the abilities with what its profile says of its category; rules on an analysis are a
grouping or a join each.  Sets are compared by flags of what they hold, so no set is gathered in a row.  Rows are dealt into
parts of a bounded number of rows, so what a task sorts or groups doesn't grow with the tables.

Defined cases: blank and null codes, categories and texts are missing ones; an ability of no analysis is left out; profiles without required
categories ask for none; an analysis without an overview isn't compared; a pattern of a profile must be valid.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.operators.ordered import parts

#: Names of the rules and which of them only warn, what stands for no content, and the least length of content.
RULES = {
    "model": "ability_model_mismatch",
    "categories": "ability_category_incomplete",
    "category": "ability_major_category_code_missing",
    "pattern": "ability_code_pattern_mismatch",
    "task": "ability_relation_task_missing",
    "content_link": "ability_relation_work_content_missing_for_p_category",
    "sets": "ability_cross_sheet_inconsistency",
    "orphan": "ability_orphan",
    "copies": "ability_code_duplicate",
    "quality": "ability_content_quality_low",
    "evidence": "ability_evidence_missing",
}
WARNINGS = ["sets", "quality", "evidence"]
NOTHING = ["……", "...", "—", "-", "无", "N/A", "n/a", "TBD"]
SHORTEST = 4


def _none(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""


def _of_items(known: DataFrame) -> DataFrame:
    """Findings of single abilities."""
    text = F.trim(F.coalesce("content", F.lit("")))
    given = F.coalesce("category", F.lit("")) != ""
    patterned = given & (F.coalesce("regex", F.lit("")) != "")
    holds = {
        "category": _none("category"),
        "pattern": patterned & ~F.regexp_like(F.coalesce("code", F.lit("")), F.concat(F.lit("^(?:"), F.col("regex"), F.lit(")$"))),
        "task": F.col("task").isNull(),
        "content_link": F.col("task").isNotNull() & given & F.coalesce("needs_content", F.lit(False)) & F.col("work_content").isNull(),
        "orphan": F.col("task").isNull() & _none("category"),
        "quality": text.isin(NOTHING) | text.rlike(r"^[0-9]+$") | (F.length(text) < SHORTEST),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in holds.items()]))
    return known.select("analysis", F.lit("ability_item").alias("kind"), F.col("ability").cast("string").alias("subject"), F.explode(found).alias("rule"))


def _flagged(sides: list[DataFrame], keys: list[str], n: int) -> DataFrame:
    """(keys, held) of the rows of all ``sides``, each once: bit k of ``held`` is set if side k has it."""
    flagged = reduce(DataFrame.unionByName, [x.select(*keys, F.lit(1 << k).alias("held")) for k, x in enumerate(sides)])
    return flagged.repartition(n, *keys).groupBy(*keys).agg(F.bit_or("held").alias("held"))


def _unequal(overview: DataFrame, persisted: DataFrame, implied: DataFrame, n: int) -> DataFrame:
    """(analysis) of those whose three sets of (analysis, code) aren't equal; only those with an overview are looked at."""
    named = [x.filter("analysis is not null") for x in (persisted, implied)]
    held = _flagged([overview, *named], ["analysis", "code"], n).repartition(n, "analysis")
    seen = held.groupBy("analysis").agg(F.bit_or("held").alias("any"), F.count_if(F.col("code").isNotNull() & (F.col("held") != 7)).alias("apart"))
    return seen.filter((F.col("any").bitwiseAND(1) == 1) & (F.col("apart") > 0)).select("analysis")


def findings(analyses: DataFrame, specs: DataFrame, abilities: DataFrame, contents: DataFrame, overview: DataFrame) -> DataFrame:
    """(analysis, kind, subject, rule, severity) of all that the rules find.

    analyses: analysis, profile, model, declared, linked (a source).  specs: profile, category, required, regex, needs_content, segments.  abilities: analysis, ability, code,
    category, content, task, work_content.  contents and overview: analysis, code of work contents; an analysis with an overview of nothing has a row with a null code.
    """
    n = parts(analyses.count(), abilities.count())
    heads = analyses.select("analysis", "profile")
    items = abilities.repartition(n, "analysis").join(heads.repartition(n, "analysis"), "analysis")
    known = items.join(specs, ["profile", "category"], "left")
    whole = lambda rows, rule, subject=None: rows.select("analysis", F.lit("analysis").alias("kind"), (F.lit(None).cast("string") if subject is None else F.col(subject)).alias("subject"), F.lit(rule).alias("rule"))
    required = heads.join(specs.filter(F.col("required") & (F.coalesce("category", F.lit("")) != "")).select("profile", "category"), "profile")
    absent = _flagged([required, items], ["analysis", "category"], n).filter("held = 1").select("analysis").repartition(n, "analysis").distinct()
    # A code of three segments names a work content by its first two.
    segments = F.split(F.regexp_replace("code", "^[^-]*-", ""), r"\.")
    implied = known.filter((F.col("segments") == 3) & (F.coalesce("code", F.lit("")) != "") & (F.size(segments) >= 2)).select("analysis", F.array_join(F.slice(segments, 1, 2), ".").alias("code"))
    copies = items.filter(F.coalesce("code", F.lit("")) != "").groupBy("analysis", "code").agg(F.count("*").alias("n")).filter("n > 1")
    found = [
        _of_items(known),
        whole(analyses.filter(F.coalesce("model", F.lit("")) != F.col("profile")), "model"),
        whole(absent, "categories"),
        whole(_unequal(overview, contents, implied, n), "sets"),
        whole(copies, "copies", "code"),
        whole(analyses.filter(F.coalesce("declared", F.lit(False)) & ~F.coalesce("linked", F.lit(False))), "evidence"),
    ]
    rule = F.create_map(*[F.lit(x) for kv in RULES.items() for x in kv])
    rows = reduce(DataFrame.unionByName, found)
    severity = F.when(F.col("rule").isin(WARNINGS), "warning").otherwise("blocking")
    return rows.select("analysis", "kind", "subject", rule[F.col("rule")].alias("rule"), severity.alias("severity"))

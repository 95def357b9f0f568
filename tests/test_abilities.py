"""The ten rules on small analyses: each fires where it should and nowhere else."""

from __future__ import annotations

import pytest

from siltworks.operators import abilities

ANALYSES = "analysis long, profile string, model string, declared boolean, linked boolean"
SPECS = "profile string, category string, required boolean, regex string, needs_content boolean, segments int"
ITEMS = "analysis long, ability string, code string, category string, content string, task long, work_content long"
CODES = "analysis long, code string"


@pytest.fixture
def found(spark):
    def run(analyses, items, contents=(), overview=(), specs=(("M", "P", True, r"P-\d+\.\d+\.\d+", True, 3), ("M", "G", True, r"G-\d+", False, 2))):
        make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
        rows = abilities.findings(make(analyses, ANALYSES), make(specs, SPECS), make(items, ITEMS), make(contents, CODES), make(overview, CODES)).collect()
        short = {v: k for k, v in abilities.RULES.items()}
        return sorted((r.analysis, short[r.rule], r.subject, r.severity) for r in rows)

    return run


GOOD = [(1, "a", "P-1.2.3", "P", "content", 1, 1), (1, "b", "G-4", "G", "content", 1, None)]


def test_a_whole_analysis_has_no_findings(found):
    assert found([(1, "M", "M", True, True)], GOOD, [(1, "1.2")], [(1, "1.2")]) == []


def test_each_rule_on_an_ability(found):
    items = [
        *GOOD,
        (1, "no category", "X", " ", "content", 1, 1),
        (1, "pattern", "P-1", "P", "content", 1, 1),
        (1, "task", "G-5", "G", "content", None, None),
        (1, "link", "P-1.2.4", "P", "content", 1, None),
        (1, "orphan", None, None, "content", None, None),
        (1, "short", "G-6", "G", " abc ", 1, None),
        (1, "digits", "G-7", "G", "12345", 1, None),
        (1, "null", "G-8", "G", None, 1, None),
        (9, "of no analysis", "?", "P", "", None, None),
    ]
    assert found([(1, "M", "M", False, False)], items) == [
        (1, "category", "no category", "blocking"),
        (1, "category", "orphan", "blocking"),
        (1, "content_link", "link", "blocking"),
        (1, "orphan", "orphan", "blocking"),
        (1, "pattern", "pattern", "blocking"),
        (1, "quality", "digits", "warning"),
        (1, "quality", "null", "warning"),
        (1, "quality", "short", "warning"),
        (1, "task", "orphan", "blocking"),
        (1, "task", "task", "blocking"),
    ]


def test_each_rule_on_an_analysis(found):
    analyses = [(1, "M", None, True, False), (2, "M", "N", True, None), (3, "M", "M", None, None), (4, "F", "F", False, False)]
    items = [*GOOD, *[(2, x, c, k, "content", 1, 1) for _, x, c, k, *_ in GOOD], (2, "c", "G-4", "G", "content", 1, None)]
    got = found(analyses, items, [(1, "1.2"), (2, "1.2"), (2, "9.9")], [(1, "1.2"), (2, "1.2"), (3, None)])
    assert got == [
        (1, "evidence", None, "warning"),
        (1, "model", None, "blocking"),
        (2, "copies", "G-4", "blocking"),
        (2, "evidence", None, "warning"),
        (2, "model", None, "blocking"),
        (2, "sets", None, "warning"),
        (3, "categories", None, "blocking"),
    ]


def test_empty_tables(found):
    assert found([], []) == []

"""Small functions of requests."""

from __future__ import annotations

import pytest

from siltworks.operators import selection, tags
from siltworks.plans.guard import Plan, PlanError, run
from siltworks.queries.retrieval import DISTRIBUTION, lines


def test_expansions_and_strategies():
    assert selection.clip_expansions(["a", "q", "b", "a", "c"], " q ", 2) == ["a", "b"]
    assert selection.expand_terms(["x", "y", "x"], {"x": ["z"]}) == ["x", "z", "y"]
    assert tags.parse_strategy(" L4 | l1|what") == ("l1", "l4")
    with pytest.raises(ValueError, match="no known layer"):
        tags.resolve(None, None, "l9", "AND")


def test_a_plan_with_tags_needs_an_index(spark):
    with pytest.raises(PlanError, match="no index"):
        run(Plan(tags={"brand": ["Brand#13"]}), DISTRIBUTION, lines(spark, "/root/testdata/sf0.001"))


def test_the_budget_passes_over_what_does_not_fit(spark):
    rows = spark.createDataFrame([(1, 1, 0.9, 90), (1, 2, 0.8, 20), (1, 3, 0.7, 10), (1, 4, 0.6, 0), (1, 5, 0.5, None), (2, 6, 0.1, 5000)], "k long, id long, s double, n int")
    got = {(r.k, r.id, r.place) for r in selection.within_budget(rows, "k", "s", "id", "n", 6, 100).collect()}
    assert got == {(1, 1, 0), (1, 3, 1), (2, 6, 0)}
    assert selection.within_budget(rows.limit(0), "k", "s", "id", "n").count() == 0


def test_rerank_keeps_an_order_that_was_asked_for(spark):
    rows = spark.createDataFrame([(0, 0.1), (1, 0.9), (2, 0.9), (3, None)], "rank int, score double")
    order = lambda **how: [r["rank"] for r in selection.rerank(rows, "score", "rank", **how).collect()]
    assert order() == [1, 2, 0, 3] and order(ordered=True) == order(on=False) == order(how="AND") == [0, 1, 2, 3]


def test_places_are_those_of_the_reranking(spark):
    from siltworks.operators.selection import rerank, reranked

    rows = [(k, i, None if i % 5 == 0 else (i * 7) % 4) for k in ("a", "b") for i in range(30)]
    df = spark.createDataFrame(rows, "k string, id long, score long")
    for more in ({}, {"ordered": True}, {"on": False}, {"how": "AND"}):
        placed = {(r.k, r.id): r.place for r in reranked(df, ["k"], "score", "id", **more).collect()}
        for k in ("a", "b"):
            order = [r.id for r in rerank(df.filter(df.k == k), "score", "id", **more).collect()]
            assert [placed[(k, i)] for i in order] == list(range(1, 31))


"""Walks to the end: chains deeper than a round, cycles, diamonds and nulls."""

from __future__ import annotations

import random

from siltworks.operators.selection import subtree
from siltworks.operators.trees import reach


def brute(edges, roots):
    level = dict.fromkeys(roots, 0)
    front = list(roots)
    while front:
        front = [c for p in front for a, c in edges if a == p and c not in level and level.setdefault(c, level[p] + 1)]
    return level


def walk(spark, edges, roots, **more):
    found = reach(spark.createDataFrame(edges, "parent long, child long"), spark.createDataFrame([(r,) for r in roots], "node long"), **more)
    return {r.node: r.level for r in found.collect()}


def test_chain_of_two_hundred_and_a_cycle(spark):
    chain = [(i, i + 1) for i in range(200)]
    assert walk(spark, chain, [0]) == {i: i for i in range(201)}
    round_trip = [(i, i + 1) for i in range(30)] + [(30, 0), (30, 7)]
    assert walk(spark, round_trip, [20]) == brute(round_trip, [20])


def test_random_graphs(spark):
    rng = random.Random(1)
    for stride in (1, 3, 8):
        edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(90)]
        assert walk(spark, [*edges, (None, 1), (1, None)], [0, 1], stride=stride) == brute(edges, [0, 1])


def test_no_edges_and_subtree(spark):
    assert walk(spark, [], [5]) == {5: 0}
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("x", "y")], "parent string, child string")
    assert sorted(r.node for r in subtree(edges, "a").collect()) == ["a", "b"]

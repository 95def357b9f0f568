"""Ranks, sums, runs and percentiles over range partitions, with a hot key that spans them, against plain Python."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from siltworks.operators import ordered


@pytest.fixture(params=[1, 2])
def table(request, spark):
    """Most rows have one key, some none; values tie; a column is called like a helper."""
    rng = random.Random(request.param)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), None if rng.random() < 0.1 else rng.randrange(40), i, rng.randrange(3)) for i in range(900)]
    return rows, spark.createDataFrame(rows, "k string, v int, at long, part int").repartition(5)


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_ranks(table):
    rows, df = table
    got = {r.at: r["rank"] for r in ordered.ranked(df, ["k"], [F.col("v").desc(), F.col("at").asc()]).collect()}
    want = {}
    for group in by_key(rows).values():
        for n, r in enumerate(sorted(group, key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))):
            want[r[2]] = n + 1
    assert got == want


def test_running_sums(table):
    rows, df = table
    got = {r["at"]: (r["before"], r["sum"]) for r in ordered.running(df, ["k"], [F.col("at").asc()], F.col("v"), total="sum").collect()}
    want = {}
    for group in by_key(rows).values():
        total = sum(r[1] or 0 for r in group)
        before = 0
        for r in sorted(group, key=lambda r: r[2]):
            want[r[2]] = (before, total)
            before += r[1] or 0
    assert got == want


def test_runs_go_on_over_partition_edges(table):
    rows, df = table
    got = {r["at"]: r["run"] for r in ordered.runs(df, ["k"], [F.col("at").asc()], lambda was: F.col("part") >= was["part"]).collect()}
    want = {}
    for group in by_key(rows).values():
        run, last = 0, None
        for r in sorted(group, key=lambda r: r[2]):
            run += last is None or r[3] < last
            last, want[r[2]] = r[3], run
    assert got == want


def test_one_run_over_all_partitions(spark):
    df = spark.range(4000).select(F.lit("x").alias("k"), F.col("id").alias("n"))
    got = ordered.runs(df, ["k"], [F.col("n").asc()], lambda was: F.col("n") == was["n"] + 1).groupBy("run").count().collect()
    assert [tuple(r) for r in got] == [(1, 4000)]


def test_percentiles(table):
    rows, df = table
    at = {"low": 0.0, "p37": 0.37, "mid": 0.5, "high": 1.0}
    got = {r.k: tuple(r)[1:] for r in ordered.percentiles(df, ["k"], "v", at).collect()}
    want = {}
    for k, group in by_key(rows).items():
        v = sorted(r[1] for r in group if r[1] is not None)
        place = lambda p: (len(v) - 1) * p  # noqa: B023, E731
        want[k] = tuple(v[math.floor(place(p))] + (v[math.ceil(place(p))] - v[math.floor(place(p))]) * (place(p) % 1) for p in at.values())
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_empty_tables_and_plans(spark):
    df = spark.createDataFrame([], "k string, v int")
    assert ordered.ranked(df, ["k"], [F.col("v").asc()]).collect() == []
    assert ordered.runs(df, ["k"], [F.col("v").asc()], lambda was: was["v"] == F.col("v")).collect() == []
    assert ordered.percentiles(df, ["k"], "v", {"p": 0.5}).collect() == []
    rank = ordered.ranked(spark.range(100).selectExpr("id % 2 as k", "id as v"), ["k"], [F.col("v").asc()])
    plan = rank._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and plan.count("Window [") == 1  # over the table of keys and partitions
    whole = rank.groupBy("k").agg(F.max("rank").alias("n")).orderBy("k").collect()
    assert [tuple(r) for r in whole] == [(0, 50), (1, 50)]


def test_product_of_a_key_is_made_in_many_tasks(spark):
    left = spark.range(300).selectExpr("if(id < 250, 1L, if(id < 290, 2L, null)) AS k", "id AS x")
    right = spark.range(40).selectExpr("if(id < 30, 1L, null) AS j", "id AS y")
    made = ordered.dealt_left(left, right, "k", "j")
    assert sorted(map(str, made.collect())) == sorted(map(str, left.join(right, left["k"] == right["j"], "left").collect()))
    sizes = made.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert max(r["count"] for r in sizes) < 0.2 * made.count()

"""Packing by slices against the loop, and units of chunks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siltworks.operators import packing


def loop(sizes, most, rows, overlap):
    """[(first, last, total)] of one key's rows, one after the other."""
    out, held, total = [], [], 0
    for i, n in enumerate(sizes):
        if held and (total + n > most or len(held) >= rows):
            out.append(held)
            held = held[-overlap:] if overlap else []
            total = sum(sizes[k] for k in held)
        held = [*held, i]
        total += n
    out += [held] if held else []
    return [(h[0], h[-1], sum(sizes[k] for k in h)) for h in out]


@pytest.mark.parametrize(("rows", "overlap", "slice_"), [(1, 0, 8), (3, 0, 8), (4, 1, 8), (5, 3, 16), (6, 2, 1024)])
def test_pack_equals_the_loop(spark, monkeypatch, rows, overlap, slice_):
    monkeypatch.setattr(packing, "SLICE", slice_)
    rng = random.Random(rows)
    keys = {k: [rng.choice([0, 1, 5, 30, 200]) for _ in range(rng.choice([1, 2, 9, 70]))] for k in [None, *range(12)]}
    keys[99] = [rng.randrange(50) for _ in range(700)]
    df = spark.createDataFrame([(k, i, n or None, "x") for k, sizes in keys.items() for i, n in enumerate(sizes)], "k long, i long, n long, unit string").repartition(4)
    got = {}
    for r in packing.pack(df, "k", "i", "n", 100, rows, overlap).orderBy("unit").collect():
        got.setdefault(r.k, []).append((r.unit, (r.first, r.last, r.total), r.n_rows))
    want = {k: loop(sizes, 100, rows, overlap) for k, sizes in keys.items()}
    assert {k: [u for _, u, _ in x] for k, x in got.items()} == want
    assert all([u for u, _, _ in x] == list(range(len(x))) and all(n == b - a + 1 for _, (a, b, _), n in x) for x in got.values())


def test_a_key_of_a_million_rows_goes_in_slices(spark):
    df = spark.range(1_000_000).select(F.lit(1).alias("k"), F.col("id").alias("i"), (F.col("id") * 7919 % 50).alias("n"))
    found = packing.pack(df, "k", "i", "n", 100, 6, 1)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = [tuple(r) for r in found.orderBy("unit").select("first", "last", "total").collect()]
    assert got == loop([k * 7919 % 50 for k in range(1_000_000)], 100, 6, 1)


def test_refused_and_empty(spark):
    df = spark.createDataFrame([], "k long, i long, n long")
    assert packing.pack(df, "k", "i", "n", 10, 3).collect() == []
    for rows, overlap in ((0, 0), (2, 2), (3, -1)):
        with pytest.raises(ValueError):
            packing.pack(df, "k", "i", "n", 10, rows, overlap)


def test_units_of_chunks(spark):
    rows = [(1, 0, "body", "llm", "A", 10), (1, 1, "body", "llm", "A", 10), (1, 2, "body", "llm", "B", 10), (1, 3, "table_row", "rule", "B", 5), (1, 4, "body", "llm", "B", None)]
    rows += [(1, 6, "body", "llm", "B", 10), (1, 7, "chart", "rule", None, 1), (1, 8, "body", "rule", "B", 2), (2, 0, "body", "llm", None, 9), (2, 1, "body", "llm", None, 9), (2, 2, "body", "llm", None, 9), (3, 0, None, None, None, None)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_index long, role string, method string, heading string, chars long")
    got = sorted(tuple(r) for r in packing.body_units(chunks, most=20, rows=2).collect())
    assert got == [
        (1, "chunk", 8, 8, 1, 2),
        (1, "section", 0, 1, 2, 20),
        (1, "section", 2, 2, 1, 10),
        (1, "section", 4, 4, 1, 0),
        (1, "section", 6, 6, 1, 10),
        (1, "table_row", 3, 3, 1, 5),
        (1, "visual_context", 7, 7, 1, 1),
        (2, "section", 0, 1, 2, 18),
        (2, "sliding_window", 1, 2, 2, 18),
        (3, "chunk", 0, 0, 1, 0),
    ]
    policy = packing.body_units(chunks, policy=True, most=100, rows=9).filter("doc_id = 1 and unit_type like 'policy%'").collect()
    assert sorted((r.unit_type, r.first, r.last) for r in policy) == [("policy_document", 0, 2), ("policy_document", 4, 4), ("policy_document", 6, 6)]

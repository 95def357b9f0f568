"""Cosine search with many probes."""

from __future__ import annotations

import random

from siltworks.operators import vectors


def test_many_probes_equal_brute_force(spark):
    rng = random.Random(19)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(400)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = vectors.search(v, v.filter("vec_id < 200").selectExpr("vec_id AS query", "embedding AS probe"), 0.2, 5)
    assert "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().toString()
    norm = lambda x: sum(a * a for a in x) ** 0.5
    got = {(r.query, r.id) for r in found.collect()}
    for q, x in rows[:200]:
        near = sorted((-sum(a * b for a, b in zip(x, y)) / norm(x) / norm(y), i) for i, y in rows)[:5]
        assert {i for s, i in near if -s >= 0.2} == {i for p, i in got if p == q}


def test_many_probes_score_as_few_do_on_odd_vectors(spark, monkeypatch):
    rng = random.Random(7)
    vec = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(30)]
    rows = [(i, list(vec[i % 30])) for i in range(200)]  # ties by id
    rows += [(200, None), (201, []), (202, [0.0] * 6), (203, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (204, [1.0, 2.0]), (205, [1e-160] * 6), (206, [float("nan")] + [1.0] * 5), (207, [-x for x in vec[3]])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    probes = v.filter("vec_id < 60 or vec_id in (200, 201, 202, 203, 204, 207)").selectExpr("concat('q', vec_id) AS query", "embedding AS probe")
    monkeypatch.setattr(vectors, "ROWS", 16)
    monkeypatch.setattr(vectors, "WIDE", 16)
    for threshold in (-1.0, 0.2):
        monkeypatch.setattr(vectors, "BLOCK", 64)
        many = sorted(map(repr, vectors.search(v, probes, threshold, 7).collect()))
        monkeypatch.setattr(vectors, "BLOCK", 1000)
        assert many == sorted(map(repr, vectors.search(v, probes, threshold, 7).collect()))


def test_many_probes_make_no_row_for_a_pair(spark):
    v = spark.range(600).selectExpr("id AS vec_id", "transform(sequence(1, 4), x -> double(hash(id, x) % 1000)) AS embedding")
    found = vectors.search(v, v.filter("vec_id < 100").selectExpr("vec_id AS query", "embedding AS probe"), -1.0, 5)
    assert found.count() == 500
    plan = found._jdf.queryExecution().toString()
    assert "Generate explode(probes" not in plan and "MapInArrow" in plan


def test_sections_by_fit_score_and_first_hit(spark):
    from siltworks.operators.sections import best_sections

    rows = [
        (1, "拍摄设备清单", "a", 30, "一、拍摄设备清单", 0.1, 4, False, ""),
        (1, "拍摄设备清单", "b", 10, "其他", 0.9, 1, True, "拍摄设备清单"),
        (1, "拍摄设备清单", "c", 20, "其他", 0.85, 2, False, ""),
        (1, "拍摄设备清单", "c", 21, "其他", 0.2, 5, True, ""),
        (1, "拍摄设备清单", "d", 5, "其他", 0.3, 3, None, ""),
        (2, None, "e", 1, None, None, 1, False, None),
    ]
    hits = spark.createDataFrame(rows, "query_id long, query string, section string, seq long, title string, score double, rank long, weak boolean, path string")
    got = sorted((r.query_id, r.place, r.section, r.n_hits, r.strong, round(r.score, 4)) for r in best_sections(hits).collect())
    assert got == [(1, 1, "b", 1, False, 0.82), (1, 2, "c", 2, False, 0.86), (1, 3, "a", 1, True, 0.45), (2, 1, "e", 1, False, 0.0)]
    by_path = sorted((r.place, r.section, r.strong, round(r.score, 4)) for r in best_sections(hits.filter("query_id = 1"), top=2, by_path=True).collect())
    assert by_path == [(1, "b", True, 1.17), (2, "a", True, 0.45)]

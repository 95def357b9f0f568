"""Facts by rule against plain Python, planted figures, and what validation refuses."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from siltworks.operators import facts

METRIC = facts.METRIC.replace(r"\x{4e00}", "一").replace(r"\x{9fa5}", "龥")


def fields_of(text):
    out = {}
    for line in (text or "").splitlines():
        line = line.strip(" \t|")
        mark = ":" if ":" in line else "：" if "：" in line else None
        if mark:
            key, value = (x.strip() for x in line.split(mark, 1))
            if key and value:
                out[key] = value
    return out


def metric_of(text):
    for line in (text or "").splitlines():
        if m := re.search(METRIC, line.strip()):
            return m[1].strip(), m[2].strip()
    return None


def test_fields_and_figures_equal_plain_python(spark):
    rng = random.Random(4)
    parts = ["部门: a", "| 部门：b |", "k:v:w", "x：y:z", " : v", "k:", "plain", "", "电商产值: 3.5 亿元", "占比 7%", "人数达到：-12 人", "a 5", "同比: x", "value 10 apples", "政策: p | q"]
    texts = [None, "", *["\n".join(rng.choice(parts) for _ in range(rng.randrange(6))) for _ in range(200)]]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    for r in df.select("i", facts.key_values(F.col("t")).alias("kv"), facts.first_metric(F.col("t")).alias("m")).collect():
        assert [(p.key, p.value) for p in r.kv] == list(fields_of(texts[r.i]).items())
        assert (r.m and (r.m.name, r.m.value)) == metric_of(texts[r.i])


def test_values_in_plain_units(spark):
    cases = {"3.5 亿元": (3.5e8, "元"), "-2万亿元": (-2e12, "元"), "12%": (0.12, ""), "7 人": (7.0, "人"), "1.5倍": (1.5, "倍"), "+4": (4.0, ""), "x": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    for r in df.select("v", facts.normal_value(F.col("v")).alias("n")).collect():
        want = cases[r.v]
        assert (r.n is None) if want is None else (r.n.unit == want[1] and r.n.number == pytest.approx(want[0]))


def test_planted_figures_are_found_and_sentences_are_the_text(spark):
    rng = random.Random(5)
    words = ["这里", "没有", "数字", "word"]
    texts, planted = [], {}
    for i in range(40):
        said = []
        for _ in range(rng.randrange(1, 8)):
            if rng.random() < 0.4:
                n = rng.randrange(100)
                said.append(f"产值为: {n} 亿元。")
                planted.setdefault(i, []).append(n * 1e8)
            else:
                said.append(" ".join(rng.choice(words) for _ in range(4)) + rng.choice(["。", "!", "\n", "；"]))
        texts.append("".join(said))
    rows = facts.sentences(spark.createDataFrame([*enumerate(texts), (99, None)], "i long, t string"), "i", "t")
    parts = rows.orderBy("i", "n").collect()
    for i, t in enumerate(texts):
        mine = [r for r in parts if r.i == i]
        assert "".join(r.sentence for r in mine) == t and all(t[r.start : r.end] == r.sentence for r in mine)
    found = rows.withColumn("m", facts.first_metric(F.col("sentence"))).filter("m is not null").select("i", "n", facts.normal_value(F.col("m.value"))["number"].alias("x")).orderBy("i", "n").collect()
    got = {}
    for r in found:
        got.setdefault(r.i, []).append(r.x)
    assert got == planted


def test_extraction_validation_and_counts(spark):
    rows = [(1, "table_row", "部门: 甲\n内容: 乙"), (2, "table_row", "no fields"), (3, "chart", "产值: 5%"), (4, "metric_image", ""), (5, "body", "x: 1"), (6, None, None), (7, "metric_image", "增速 8 倍")]
    found = facts.extract(spark.createDataFrame(rows, "id long, role string, content string"))
    by_id = {r.id: r for r in found.collect()}
    assert {i: r.reason for i, r in by_id.items()} == {1: None, 2: "no_fact_candidate", 3: None, 4: "no_fact_candidate", 5: "unsupported_extractor", 6: "unsupported_extractor", 7: None}
    assert (by_id[1].subject_name, by_id[1].object_literal, by_id[1].predicate, by_id[1].confidence) == ("甲", "部门: 甲; 内容: 乙", "HAS_TABLE_ROW_FACT", 0.78)
    assert (by_id[3].subject_name, by_id[3].object_literal, by_id[3].fact_type, by_id[3].confidence) == ("产值", "5%", "metric_fact", 0.78)
    good = ("s", "p", "t", "literal", "证据", 0.5, "源文 literal")
    spoilt = [good, (" ", *good[1:]), (*good[:5], 1.5, good[6]), (*good[:5], None, good[6]), (*good[:3], None, *good[4:]), (*good[:3], "长" * 2049, *good[4:]), (*good[:4], "english", *good[5:]), (*good[:3], "some other words", *good[4:]), (*good[:3], "Literal", *good[4:]), (*good[:6], "english source")]
    df = spark.createDataFrame(spoilt, "subject_name string, predicate string, fact_type string, object_literal string, evidence_text string, confidence double, source string")
    refused = [r.refused for r in facts.validated(df, "source").collect()]
    assert refused == [None, "schema_invalid", "schema_invalid", "schema_invalid", "schema_invalid", "schema_invalid", "language_mismatch", "language_mismatch", None, None]
    total = facts.summary(facts.validated(found, "content")).collect()
    assert [(r.n_accepted, r.n_refused, dict(r.reasons)) for r in total] == [(3, 4, {"no_fact_candidate": 2, "unsupported_extractor": 2})]


def test_reasons_in_their_order(spark):
    meta = "anchor_role string, graph_candidate string, profile string, domain_model string, low_quality boolean, image_role string, caption string"
    of = lambda **m: tuple(m.get(c.split()[0]) for c in meta.split(", "))
    cases = [
        ("  ", None, of(), "empty_content"),
        ("x", None, of(graph_candidate="false"), "task_outline_not_graph_candidate"),
        ("x", None, of(profile="task_outline", anchor_role="body"), "task_outline_not_graph_candidate"),
        ("x", None, of(), "missing_anchor_role"),
        ("x", "process_step", of(), None),
        ("x", None, of(anchor_role="table_overview", low_quality=True), "skipped_anchor_role"),
        ("x", None, of(anchor_role="equation"), "unsupported_anchor_role"),
        ("x", None, of(anchor_role="body", graph_candidate="skip"), "low_quality_chunk"),
        ("x", None, of(anchor_role="image", image_role="Logo"), "non_semantic_image"),
        ("QR", None, of(anchor_role="image"), "non_semantic_image"),
        ("<label> 保存", None, of(anchor_role="image", caption="登录页面"), "non_semantic_image"),
        ("<label> 保存", None, of(anchor_role="body", caption="登录页面"), None),
        (None, None, None, "empty_content"),
    ]
    df = spark.createDataFrame([(i, c, k, m) for i, (c, k, m, _) in enumerate(cases)], f"i int, content string, chunk_type string, metadata struct<{meta.replace(' ', ': ').replace(',: ', ', ')}>")
    assert {r.i: r.why for r in df.select("i", facts.skip_reason().alias("why")).collect()} == {i: c[3] for i, c in enumerate(cases)}

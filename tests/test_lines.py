"""Automata over slices, entries, triples, merged chapters and lifted chunks against walks in plain Python."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from siltworks.operators import headings, lines


def walk_entries(rows, fields=lines.TAG_FIELDS):
    out, current = [], {}
    for line in [*rows, ""]:
        line = (line or "").strip()
        if not line:
            out += [current] if current else []
            current = {}
            continue
        for f in fields:
            if m := re.match(rf"{re.escape(f)}\s*[:：]\s*(.+)", line):
                current[f] = m[1].strip()
                break
        else:
            if not current:
                current[fields[0]] = line
    return out


@pytest.mark.parametrize("size", [1, 3, 256])
def test_entries_equal_a_walk_at_any_slice(spark, size):
    rng = random.Random(1)
    kinds = ["", " \t", None, "标签名: a", "分类：b ", " 分类 :c", "描述:", "name", "x: y", "标签名：z", "层级:1"]
    docs = {d: [rng.choice(kinds) for _ in range(rng.randrange(40))] for d in range(40)}
    df = spark.createDataFrame([(d, i, line, "x") for d, rows in docs.items() for i, line in enumerate(rows)], "doc_id long, seq int, line string, state string").repartition(4)
    got = {}
    for r in lines.entries(df, size=size).collect():
        got[(r.doc_id, r.entry)] = (r.name, dict(r.fields))
    want = {(d, k): (e.get("标签名", f"tag_{k}"), e) for d, rows in docs.items() for k, e in enumerate(walk_entries(rows))}
    assert got == want


def test_scan_is_any_automaton(spark):
    """A counter modulo 3 that emits at each full turn."""
    rng = random.Random(2)
    rows = [(k, i, rng.randrange(3)) for k in (None, 1) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, i long, n int")
    step = lambda s, x: ((s + x["n"]) % 3, F.floor((s + x["n"]) / 3))
    got = {(r.k, r.i): (r.state, r["count"]) for r in lines.scan(df, ["k"], "i", 3, step, size=7).collect()}
    for k in (None, 1):
        total = 0
        for _, i, n in (r for r in rows if r[0] == k):
            assert got[(k, i)] == (total % 3, total // 3)
            total += n


def test_triples_and_evidence(spark):
    text = "Java -[依赖]-> JVM\n\n  SQL 包含 SELECT \nnothing\nJava and JVM\nSELECT"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    found = lines.triples(df)
    assert sorted((r.n, r.subject, r.predicate, r.object, text[r.start : r.end]) for r in found.collect()) == [(0, "Java", "依赖", "> JVM", "Java -[依赖]-> JVM"), (2, "SQL", "关联", "SELECT", "  SQL 包含 SELECT ")]
    at, blocks = 0, []
    for k, part in enumerate(text.split("\n")):
        blocks.append((1, f"b{k}", k, part, at, at + len(part)))
        at += len(part) + 1
    rows = lines.with_evidence(found, spark.createDataFrame(blocks, "doc_id long, block_id string, seq int, text string, start int, end int")).collect()
    got = {r.n: ([*r.primary], [*r.evidence]) for r in rows}
    assert got == {0: (["b0"], ["b4"]), 2: (["b2"], ["b5"])}
    many = spark.createDataFrame([(1, f"c{k}", k, "Java SELECT", 1000 + k, 1001 + k) for k in range(9)], "doc_id long, block_id string, seq int, text string, start int, end int")
    some = {r.n: [*r.evidence] for r in lines.with_evidence(found, many).collect()}
    assert some == {0: [f"c{k}" for k in range(5)], 2: [f"c{k}" for k in range(5)]}


def test_evidence_is_all_that_a_walk_finds(spark):
    """Concepts that most blocks hold, with more primary blocks than evidence, as one block after the other is read."""
    rng = random.Random(5)
    blocks = [(d, f"b{k}", k, "".join(rng.choice("abc") for _ in range(6)), k * 6, k * 6 + 6) for d in (1, 2) for k in range(40)]
    found = [(d, n, "".join(rng.choice("abc") for _ in range(rng.randrange(4))), "r", "".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))), at, at + rng.choice([1, 9, 80])) for d in (1, 2) for n, at in enumerate(range(0, 120, 11))]
    made = lines.with_evidence(spark.createDataFrame(found, "doc_id long, n int, subject string, predicate string, object string, start int, end int"), spark.createDataFrame(blocks, "doc_id long, block_id string, seq int, text string, start int, end int"))
    assert not any(x in made._jdf.queryExecution().toString() for x in ("said_, key_", "explode(array_distinct"))  # no row for each pair of characters
    got = {(r.doc_id, r.n): ([*r.primary], [*r.evidence]) for r in made.collect()}
    assert len(got) == len(found)
    for d, n, subject, _, object_, start, end in found:
        mine = [b for b in blocks if b[0] == d]
        primary = [b[1] for b in mine if b[4] < end and b[5] > start]
        first = [b[1] for b in mine if subject and subject in b[3] and b[1] not in primary][:5]
        then = [b[1] for b in mine if object_ in b[3] and b[1] not in primary + first][:5]
        assert got[(d, n)] == (primary, first + then)


def walk_chapters(rows):
    out, i = [], 0
    while i < len(rows):
        idx, at, label, text = rows[i]
        if label == "chapter" and i + 1 < len(rows) and rows[i + 1][2] == "chapter" and re.match(headings.BARE_CHAPTER, text.strip()) and rows[i + 1][1] - at <= 3:
            out.append((idx, f"{text.strip()} {rows[i + 1][3].strip()}", True))
            i += 2
        else:
            out.append((idx, text, False))
            i += 1
    return out


def test_chapters_equal_a_walk(spark):
    rng = random.Random(3)
    docs = {}
    for d in range(80):
        at, rows = 0, []
        for idx in range(rng.randrange(20)):
            at += rng.choice([1, 1, 1, 2, 3, 4])
            rows.append((idx, at, rng.choice(["chapter"] * 6 + ["point"]), rng.choice(["项目一", "第2章", " 单元 3 ", "项目一 认知", "title"])))
        docs[d] = rows
    df = spark.createDataFrame([(d, *r, "x") for d, rows in docs.items() for r in rows], "doc_id long, idx int, block_index int, label string, text string, other string")
    got = {}
    for r in headings.merge_chapters(df).orderBy("doc_id", "idx").collect():
        got.setdefault(r.doc_id, []).append((r.idx, r.text, r.merged))
    assert got == {d: walk_chapters(rows) for d, rows in docs.items() if rows}


def test_chunks_go_to_the_deepest_title_of_one_target(spark):
    targets = spark.createDataFrame([(1, "A, b", 1), (1, "Same", 2), (1, "same.", 3), (1, "Deep", 4), (2, "A b", 5), (1, " ", 6)], "doc_id long, title string, target long")
    chunks = spark.createDataFrame([(1, 1, ["A B", "deep"]), (1, 2, ["ab", "SAME"]), (1, 3, ["Same"]), (1, 4, None), (1, 5, [None, "", "x"]), (2, 6, ["ab", "deep"])], "doc_id long, chunk_id long, path array<string>")
    assert sorted((r.chunk_id, r.target) for r in headings.lift(chunks, targets).collect()) == [(1, 4), (2, 1), (6, 5)]


def walk_paragraphs(text):
    out, cursor = [], 0
    for raw in text.split("\n\n"):
        if said := raw.strip():
            start = cursor + raw.find(said)
            out.append((said, start, start + len(said)))
        cursor += len(raw) + 2
    return out


def walk_indicators(text):
    out, current, span, cursor = [], {}, None, 0
    for line in [*text.split("\n"), ""]:
        if not line.strip():
            if current:
                out.append(("\n".join(f"{k}: {v}" for k, v in current.items()), *span))
            current, span = {}, None
        for f in lines.INDICATOR_FIELDS:
            if m := re.match(rf"{f}\s*[:：]\s*(.+)", line.strip()):
                current[f] = m[1].strip()
                span = (span[0] if span else cursor, cursor + len(line))
                break
        cursor += len(line) + 1
    return out or walk_paragraphs(text)


def walk_steps(text):
    marks = "|".join(lines.STEP_MARKS)
    regex = rf"(?:^|\n)\s*(?:({marks})\s*\d*[:：.、]?\s*)(.*?)(?=\n\s*(?:{marks})\s*\d*[:：.、]|\Z)"
    out = [(m[1].strip(), m[2].strip()) for m in re.finditer(regex, text, re.DOTALL) if m[2].strip()]
    return out or [(f"段落{i + 1}", p[0]) for i, p in enumerate(walk_paragraphs(text))]


@pytest.mark.parametrize("size", [2, 256])
def test_indicators_and_steps_equal_walks(spark, size):
    rng = random.Random(7)
    kinds = ["", "", " ", "指标: a", " 权重：3 ", "评分标准:", "维度 : x", "指标：b", "plain", "步骤 1：do", "Step2. it", " 阶段、", "Step", "é𝒳 word"]
    texts = ["", "one", "\n\n x \n\n\ny\n"] + ["\n".join(rng.choice(kinds[: rng.choice([9, 14])]) for _ in range(rng.randrange(25))) for _ in range(120)]
    df = spark.createDataFrame([*enumerate(texts), (999, None)], "doc_id long, text string").repartition(4)
    measured, stepped = {}, {}
    for r in lines.indicators(df, size=size).orderBy("doc_id", "n").collect():
        measured.setdefault(r.doc_id, []).append((r.content, r.start, r.end))
    for r in lines.steps(df).orderBy("doc_id", "n").collect():
        stepped.setdefault(r.doc_id, []).append((r.title, r.content))
    assert measured == {i: w for i, t in enumerate(texts) if (w := walk_indicators(t))}
    assert stepped == {i: w for i, t in enumerate(texts) if (w := walk_steps(t))}

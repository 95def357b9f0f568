"""Record tables and metric cards against plain Python, and the defined cases."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from siltworks.operators import tables


def cells(line):
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    line = line[:-1] if line.endswith("|") else line
    return [re.sub(r"\s+", " ", c.strip().replace("<br>", " / ").strip()) for c in line.split("|")]


def read(text):
    """(headers, [(cells, raw)]) line by line."""
    lines = [x.strip() for x in text.splitlines() if "|" in x]
    at = next((i for i in range(1, len(lines)) if all(re.fullmatch(r":?-{3,}:?", c) for c in cells(lines[i]))), None)
    if len(lines) < 3 or at is None:
        return None
    headers, rows = cells(lines[at - 1]), []
    if "" in headers:
        return None
    for raw in lines[at + 1 :]:
        c = cells(raw)
        if len(c) != len(headers) or not any(c):
            continue
        filled = [i for i, x in enumerate(c) if x]
        naming = [i for i, h in enumerate(headers[:-1]) if any(w in h for w in tables.STRONG_WORDS)]
        more = filled == [len(c) - 1] or (naming and not any(c[i] for i in naming) and filled[0] >= max(naming))
        if rows and more:
            old, was = rows[-1]
            rows[-1] = ([" ".join(x for x in (a, b) if x) for a, b in zip(old, c, strict=True)], f"{was}\n{raw}")
        else:
            rows.append((c, raw))
    return (headers, rows) if rows else None


def random_table(rng):
    heads = rng.sample(["时间", "部门", "说明", "项目", "内容", "x y", "2020", ""], rng.randrange(1, 5))
    line = lambda c: rng.choice(["|{}|", "{}", " | {} | ", "|{}"]).format("|".join(c))
    rows = [line([rng.choice(["", "", "a", " b  c ", "d<br>e", "7%"]) for _ in range(rng.choice([len(heads)] * 5 + [2]))]) for _ in range(rng.randrange(7))]
    rule = line([rng.choice(["---", ":---:", " ---- ", "---"]) for _ in heads]) if rng.random() < 0.9 else "|--|--|"
    return "\n".join(["intro", "no | table"] * rng.randrange(2) + [line(heads), rule, *rows, "after"])


def test_tables_equal_line_by_line(spark):
    rng = random.Random(2)
    texts = [random_table(rng) for _ in range(400)] + ["", "| a | b |", "|a|b|\r\n|---|---|\r\n|1|2|"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = {r.i: r.t and ([*r.t.headers], [([*x.cells], x.raw) for x in r.t.rows]) for r in df.select("i", tables.parse(F.col("text")).alias("t")).collect()}
    for i, text in enumerate(texts):
        want = read(text)
        assert got[i] == (want and (want[0], want[1])), text


def test_record_tables_are_taken_apart(spark):
    record = "| 时间 | 部门 | 内容 |\n|---|---|---|\n| 2020 | A | one |\n| | | two |\n| 2021 | B | |"
    matrix = "| 项目 | 2020 | 2021 | 2022 |\n|---|---|---|---|\n| a | 1 | 2 | 3 |\n| b | 4 | 5 | 6% |"
    rows = [(1, 1, "table", record, None, " 表1 "), (2, 1, "table", matrix, None, None), (3, 1, "table", matrix, "row_atomic", None), (4, 1, "table", record, "matrix", None), (5, 1, "paragraph", record, None, None), (6, 1, "table", None, None, None)]
    out = tables.explode_tables(spark.createDataFrame(rows, "doc_id long, seq long, block_type string, text string, hint string, caption string")).collect()
    of = lambda d: sorted((r.row, r.block_type, r.text, r.start, r.end, r.n_rows) for r in out if r.doc_id == d)
    assert of(1) == [
        (0, "table", "表格概览：共 2 条记录；字段：时间 / 部门 / 内容", None, None, 2),
        (1, "table_row", "表1 | 时间: 2020 | 部门: A | 内容: one two", record.index("| 2020"), record.index("\n| 2021"), 2),
        (2, "table_row", "表1 | 时间: 2021 | 部门: B", record.index("| 2021"), len(record), 2),
    ]
    assert len(of(3)) == 3 and of(3)[1][2] == "表格行记录 | 项目: a | 2020: 1 | 2021: 2 | 2022: 3"
    for d, text in ((2, matrix), (4, record), (5, record), (6, None)):
        assert [(r.row, r.text, r.n_rows) for r in out if r.doc_id == d] == [(None, text, None)]


def test_cards_equal_a_walk_over_runs(spark):
    rng = random.Random(3)
    kinds = ["# 核心指标", "同比增长 3%", "12 亿元", "第一章 5 家", "plain", "", "1、 数据"]
    rows, want = [], []
    for d in range(30):
        seq, was = 0, None
        for _ in range(20):
            seq += rng.choice([1, 1, 1, 2])
            kind, text = rng.choice(["heading", "heading", "title", "paragraph", None]), rng.choice(kinds)
            rows.append((d, seq, kind, text))
            said = text.lstrip("#").strip()
            head = kind in ("heading", "title")
            if head and said in ("同比增长 3%", "12 亿元"):
                group = was is not None and was[0] == seq - 1 and was[1]
                want.append((d, was[0] if group else seq, f"{was[2]}\n{said}" if group else said, [was[0], seq] if group else [seq]))
            was = (seq, head and said in ("核心指标", "1、 数据"), said)
    df = spark.createDataFrame(rows, "doc_id long, seq long, block_type string, text string").repartition(3)
    assert sorted((r.doc_id, r.seq, r.text, [*r.consumed]) for r in tables.metric_cards(df).collect()) == sorted(want)

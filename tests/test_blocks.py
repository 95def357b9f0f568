"""Every reason for which a block goes, promoted headings, and the whole chain on a small document."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.functions import noise
from siltworks.operators import blocks

BLOCK = "doc_id long, seq long, block_type string, page long, text string, caption string, area double, decorative boolean, hint string"

CASES = [
    ("paragraph", "real words of a text", None, 9, None, True, "decorative"),
    ("image", "The image shows a QR code", None, 9, None, None, "qr_code"),
    ("image", "A scan of a QR code for users", "label", 9, None, None, None),
    ("image", " ", None, 9, None, None, "empty_media"),
    ("chart", "- 12 -", None, 9, None, None, "empty_media"),
    ("image", "***", "A1", 9, 900.0, None, "empty_media"),
    ("image", "***", "A1", 9, None, None, None),
    ("image", "", "Figure of words", 9, 1.0, None, None),
    ("table", "", None, 9, None, None, None),
    ("paragraph", None, None, 9, None, None, "empty"),
    (None, "Page 3 of 9", None, 9, None, None, "footer"),
    ("paragraph", "123", None, 9, None, None, "digits"),
    ("paragraph", "——__", None, 9, None, None, "symbols"),
    ("paragraph", "a b c", None, 9, None, None, "short"),
    ("list", "About us and more", None, 9, None, None, "promotion"),
    ("paragraph", "主 编：甲、乙", None, 9, None, None, "metadata"),
    ("paragraph", "参考文献", None, 9, None, None, "metadata"),
    ("paragraph", "短视频制作实践教程", None, 5, None, None, "title_echo"),
    ("paragraph", "短视频制作实践教程", None, 6, None, None, None),
    ("paragraph", "短视频制作实践教程2", None, 1, None, None, None),
    ("paragraph", "第一章 概述......12", None, 9, None, None, "contents"),
    ("paragraph", "PART ONE", None, 9, None, None, "contents"),
    ("paragraph", "（一）甲乙 12 （二）丙丁 15", None, 9, None, None, "contents"),
    ("paragraph", "an ordinary sentence that stays.", None, 1, None, None, None),
]


def test_each_reason(spark):
    df = spark.createDataFrame([(i, *c[:6]) for i, c in enumerate(CASES)], "i int, kind string, text string, caption string, page long, area double, decorative boolean")
    got = {r.i: r.why for r in df.select("i", noise.dropped(*[F.col(c) for c in ("kind", "text", "caption", "page", "area", "decorative")]).alias("why")).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[6] for c in CASES]


def test_policy_headings(spark):
    texts = {"一、重点任务": 2, "第三章 概述": 2, "（三）建设实训基地": 3, "（3）建设实训基地": 4, "7. 加大支持力度": 4, "2. 同比增长 5%": None, "一、": None, "plain words": None, "一、这是一句话。后面还有": None, None: None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.level for r in df.select("t", F.when(noise.is_policy_heading(F.col("t")), noise.policy_level(F.col("t"))).alias("level")).collect()}
    assert got == texts


def test_the_whole_chain(spark):
    table = "| 时间 | 部门 | 内容 |\n|---|---|---|\n| 2020 | A | one |\n| 2021 | B | two |"
    rows = [
        (1, "heading", 1, "Title of it all"),
        (2, "paragraph", 1, "一、重点任务"),
        (3, "paragraph", 1, "A sentence that goes on"),
        (4, "paragraph", 2, "to its end here."),
        (5, "paragraph", 2, "Page 2 of 9"),
        (6, "table", 2, table),
        (7, "paragraph", 2, "来源：统计局"),
        (8, "heading", 3, "核心指标"),
        (9, "heading", 3, "产值 12 亿元"),
        (10, "paragraph", 3, "A sentence of its own."),
        (11, "paragraph", 3, "A sentence of its own."),
    ]
    df = spark.createDataFrame([(1, s, k, p, t, None, None, None, None) for s, k, p, t in rows] + [(2, 1, None, None, None, None, None, None, None)], BLOCK).repartition(3)
    got = sorted((r.seq, r.row or 0, r.block_type, r.text, [*r.attached], [*r.merged_from], r.heading) for r in blocks.repack_all(df).collect())
    assert got == [
        (3, 0, "paragraph", "A sentence that goes onto its end here.", [], [3, 4], "一、重点任务"),
        (6, 0, "table", "表格概览：共 2 条记录；字段：时间 / 部门 / 内容", ["来源：统计局"], [6], "一、重点任务"),
        (6, 1, "table_row", "表格行记录 | 时间: 2020 | 部门: A | 内容: one", ["来源：统计局"], [6], "一、重点任务"),
        (6, 2, "table_row", "表格行记录 | 时间: 2021 | 部门: B | 内容: two", ["来源：统计局"], [6], "一、重点任务"),
        (8, 0, "metric_image", "核心指标\n产值 12 亿元", [], [8, 9], "一、重点任务"),
        (10, 0, "paragraph", "A sentence of its own.", [], [10], "一、重点任务"),
    ]
    assert blocks.repack_all(df.limit(0)).collect() == []

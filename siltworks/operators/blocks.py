"""Blocks of documents repacked to units: drops, folds and merges as filters and windows within a document.

A block is a row (doc_id, seq, block_type, page, text); seq orders the blocks of a document and is unique there.
Null types count as none of those named, null texts as empty; a document's blocks are what a task holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from siltworks.functions import noise
from siltworks.operators import tables
from siltworks.operators.ordered import written

HEADINGS, MEDIA = ["heading", "title"], ["table", "chart", "image", "code", "equation"]
#: What ends a sentence; what begins an item; footers; what is said about a figure; marks of a publisher's page.
TERMINATORS = "。！？；…!?;.”\"’')）】]］」』》｝"
ITEM = r"^([#*•·-]|[0-9]+[.、)）]\s)"
FOOTER = r"(?i)^\s*(第\s*[0-9]+\s*页(\s*/\s*共\s*[0-9]+\s*页)?|[-—]\s*[0-9]+\s*[-—]|Page\s+[0-9]+(\s+of\s+[0-9]+)?|P[.\s]*[0-9]+)\s*$"
ATTRIBUTION = [r"^\s*(数据来源|资料来源|来源)\s*[:：]", r"^\s*注[0-9]*[：:]", r"^\s*[图表]\s*[0-9]+([-－.][0-9]+)*[\s:：]", r"(?i)^\s*(Figure|Fig\.?|Table|Source)\s*[:：]?\s*[0-9]"]
PUBLICATION = [
    "策划编辑", "责任绘图", "责任编辑", "责任校对", "封面设计", "版式设计", "出版发行", "出版社", "社址", "邮政编码", "印刷", "开本", "印张", "字数", "咨询电话", "网址",
    "网上订购", "版权所有", "物料号", "WBS要素", "正式出版前", "缺页", "倒页", "脱页", "质量问题", "第1版", "第 1 版", "印次", "反盗版", "举报电话", "举报邮箱", "通信地址", "知识产权与法律事务部",
]
NOT_PUBLICATION = "学习目标|任务描述|任务实施|知识准备|知识链接|实践训练|案例|技能点|操作步骤|项目[一二三四五六七八九十0-9]|任务[一二三四五六七八九十0-9]"
PUBLISHER_MARK = "(?i)(http|www\\.|400-[0-9]|ISBN|WBS要素|版权所有)"


def in_doc() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("seq")


def _text(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _is(kinds: list[str]) -> Column:
    return F.coalesce(F.col("block_type").isin(kinds), F.lit(False))


def navigational(blocks: DataFrame) -> DataFrame:
    """Without headings, also those written as paragraphs that begin with #."""
    text = F.regexp_replace(_text(), r"^\s+", "")
    marked = text.startswith("#") & F.substring(text, 1, 6).contains(" ") & _is(["paragraph"])
    return blocks.filter(~(_is(HEADINGS) | marked))


def meaningless(blocks: DataFrame, least: int = 4) -> DataFrame:
    """Without blocks, other than media, that are empty, a footer, digits, punctuation or under ``least`` characters."""
    text = F.trim(_text())
    short = F.length(F.regexp_replace(text, r"\s+", "")) < least
    return blocks.filter(_is(MEDIA) | ~(text.rlike(FOOTER) | text.rlike(r"^[0-9]{1,4}$") | text.rlike(r"^[^\p{L}\p{N}]*$") | short))


def attributions(blocks: DataFrame, most: int = 120, ahead: int = 3) -> DataFrame:
    """Short paragraphs that name a figure or source go to the media block before, within a page, or else to one of the next ``ahead`` blocks.

    Adds ``attached``: the array of texts folded into a block, in order; those without a host stay.
    """
    named = F.lit(False)
    for p in ATTRIBUTION:
        named = named | _text().rlike(p)
    named = named & _is(["paragraph"]) & (F.length(F.trim(_text())) <= most)
    media = F.when(_is(MEDIA), F.struct("seq", "page"))
    before = F.last(media, ignorenulls=True).over(in_doc().rowsBetween(Window.unboundedPreceding, -1))
    after = F.coalesce(*[F.lead(media, k).over(in_doc()) for k in range(1, ahead + 1)])
    hosted = F.when(F.abs(before["page"] - F.col("page")) <= 1, before["seq"]).otherwise(after["seq"])
    marked = blocks.select("doc_id", "seq", "block_type", "page", "text", F.when(named, hosted).alias("host"))
    folded = marked.filter("host is not null").groupBy("doc_id", F.col("host").alias("seq")).agg(F.sort_array(F.collect_list(F.struct(F.col("seq").alias("s"), "text"))).alias("said"))
    left = marked.filter("host is null").drop("host").join(folded, ["doc_id", "seq"], "left")
    return left.select("doc_id", "seq", "block_type", "page", "text", F.coalesce(F.transform("said", lambda x: x["text"]), F.array().cast("array<string>")).alias("attached"))


def continuations(blocks: DataFrame, headings: DataFrame | None = None, pages: int = 1) -> DataFrame:
    """Paragraphs whose sentence isn't ended joined with the next paragraph, unless that begins an item, is further than ``pages`` away, or a
    row of ``headings`` (doc_id, seq) lies between.  Adds ``merged_from``: the array of seqs; the first gives seq and page."""
    rows = blocks.select("doc_id", "seq", "block_type", "page", "text").withColumn("mark", F.lit(0))
    if headings is not None:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("block_type", "string"), ("page", "long"), ("text", "string"))]
        rows = rows.unionByName(headings.select("doc_id", "seq", *none, F.lit(1).alias("mark")))
    rows = rows.withColumn("level", F.sum("mark").over(Window.partitionBy("doc_id").orderBy("seq", "mark"))).filter("mark = 0")
    was = lambda c: F.lag(c).over(in_doc())
    ended = F.substring(F.regexp_replace(F.coalesce(was("text"), F.lit("")), r"\s+$", ""), -1, 1)
    begins = F.regexp_replace(_text(), r"^\s+", "")
    joins = (was("block_type") == "paragraph") & _is(["paragraph"]) & (was("level") == F.col("level")) & (ended != "") & ~F.lit(TERMINATORS).contains(ended)
    joins = joins & (begins != "") & ~begins.rlike(ITEM) & F.coalesce(F.abs(F.col("page") - was("page")) <= pages, F.lit(True))
    runs = rows.withColumn("opens", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("opens").over(in_doc()))
    parts = runs.groupBy("doc_id", "run").agg(F.sort_array(F.collect_list(F.struct("seq", "block_type", "page", "text"))).alias("parts"))
    first = F.get("parts", F.lit(0))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    return parts.select("doc_id", first["seq"].alias("seq"), first["block_type"].alias("block_type"), first["page"].alias("page"), text.alias("text"), F.transform("parts", lambda p: p["seq"]).alias("merged_from"))


def is_publication_noise(text: Column) -> Column:
    """Three of a publisher's marks, or two and an address, number or ISBN, in a text of 20 characters or more without marks of lessons."""
    compact = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")
    hits = sum((compact.contains(w).cast("int") for w in PUBLICATION), F.lit(0))
    return (F.length(compact) >= 20) & ~compact.rlike(NOT_PUBLICATION) & ((hits >= 3) | ((hits >= 2) & compact.rlike(PUBLISHER_MARK)))


def publication_pages(blocks: DataFrame) -> DataFrame:
    """Without paragraphs of a publisher's page; they show only once continuations are merged."""
    return blocks.filter(~(_is(["paragraph"]) & is_publication_noise(F.col("text"))))


def with_context(units: DataFrame, headings: DataFrame) -> DataFrame:
    """Adds ``heading``: the text of the last row of ``headings`` (doc_id, seq, text) before a unit."""
    both = units.select("*", F.lit(None).cast("string").alias("said")).unionByName(headings.select("doc_id", "seq", F.coalesce("text", F.lit("")).alias("said")), allowMissingColumns=True)
    last = F.last("said", ignorenulls=True).over(in_doc().rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumn("heading", last).filter("said is null").drop("said")


def repack(blocks: DataFrame) -> DataFrame:
    """The whole chain: (doc_id, seq, block_type, page, text, attached, merged_from, heading), the first of equal texts of a document."""
    headings = blocks.filter(_is(HEADINGS))
    hosts = attributions(meaningless(navigational(blocks)))
    merged = publication_pages(continuations(hosts, headings))
    units = with_context(merged.join(hosts.select("doc_id", "seq", "attached"), ["doc_id", "seq"]), headings)
    first = F.row_number().over(Window.partitionBy("doc_id", "block_type", "text").orderBy("seq"))
    return units.withColumn("nth", first).filter("nth = 1").drop("nth")


def promoted(blocks: DataFrame) -> DataFrame:
    """Short numbered paragraphs and list items as headings; adds ``level`` (null for the others)."""
    is_heading = F.coalesce(F.col("block_type").isin("paragraph", "list"), F.lit(False)) & noise.is_policy_heading(F.col("text"))
    return blocks.withColumn("level", F.when(is_heading, noise.policy_level(F.col("text")))).withColumn("block_type", F.when(is_heading, "heading").otherwise(F.col("block_type")))


def repack_all(blocks: DataFrame) -> DataFrame:
    """The whole chain over blocks (doc_id, seq, block_type, page, text, caption, area, decorative, hint): (doc_id, seq, row, block_type, page, text, attached, merged_from, heading).

    Numbered paragraphs become headings, headings with figures become metric cards and are no context then, blocks without content go, attributions are folded,
    continuations merged, publishers' pages dropped, record tables taken apart (``row`` numbers what comes out of one), and every unit
    gets the last heading before it; of equal units of a document the first stays.
    """
    why = noise.dropped(*[F.col(c) for c in ("block_type", "text", "caption", "page", "area", "decorative")])
    columns = ("doc_id", "seq", "block_type", "page", "text", "caption", "hint")
    rows = written(promoted(blocks).select(*columns, why.isNotNull().alias("dropped")))  # read by many branches
    slim = rows.select("doc_id", "seq", "block_type", "page", "text")
    cards = tables.metric_cards(slim)
    used = cards.select("doc_id", F.explode("consumed").alias("seq")).distinct()
    headings = slim.filter(_is(HEADINGS)).join(used, ["doc_id", "seq"], "left_anti")
    kept = navigational(rows.filter("not dropped"))
    hosts = attributions(kept)
    merged = publication_pages(continuations(hosts, slim.filter(_is(HEADINGS))))
    told = merged.join(hosts.select("doc_id", "seq", "attached"), ["doc_id", "seq"]).join(rows.select("doc_id", "seq", "hint", "caption"), ["doc_id", "seq"])
    apart = tables.explode_tables(told.select("doc_id", "seq", "block_type", "text", "hint", "caption")).select("doc_id", "seq", "row", "block_type", "text")
    units = apart.join(told.select("doc_id", "seq", "page", "attached", "merged_from"), ["doc_id", "seq"])
    none = F.array().cast("array<string>")
    figures = cards.select("doc_id", "seq", F.lit(None).cast("int").alias("row"), F.lit("metric_image").alias("block_type"), "text", none.alias("attached"), F.col("consumed").cast("array<bigint>").alias("merged_from"))
    figures = figures.join(slim.select("doc_id", "seq", "page"), ["doc_id", "seq"])
    units = units.withColumn("merged_from", F.col("merged_from").cast("array<bigint>")).unionByName(figures)
    first = F.row_number().over(Window.partitionBy("doc_id", "block_type", "text").orderBy("seq", "row"))
    return with_context(units, headings).withColumn("nth", first).filter("nth = 1").drop("nth")

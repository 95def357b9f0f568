"""Raw pages to tokens, blocks, main content and sections, all of it in the JVM.

``tokens`` lays a page out as a table of events: tags, raw elements and texts in
order, whose pieces put together are the page again.  What a parser keeps in its state
is a running sum over that table: how deep a token lies in elements that are left out, in
links and in containers, and the number of the block it belongs to.  A
page's tokens are what a window holds; they may spill.

Defined cases: null and empty pages have no tokens and no blocks; elements that are never closed
last to the end of the page, closing tags that nothing opened are ignored, and so are
the void elements among those left out, which hold nothing; a ``<`` that begins no tag is
text; pages are rows, so repeated or null page ids are kept apart; other columns than
page_id and html are ignored.
"""

from __future__ import annotations

import html as entities
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

#: Elements left out, elements that begin and end blocks, elements without content, marks of text that isn't content.
SKIPPED = ["head", "title", "meta", "link", "script", "style", "noscript", "svg", "canvas", "iframe", "form", "nav", "footer"]
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
PARAGRAPHS = ["p", "div", "article", "section"]
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
NOISE = ["分享到", "扫一扫", "上一篇", "下一篇", "相关阅读", "相关链接", "友情链接", "打印本页", "关闭窗口", "网站地图", "版权所有", "Copyright", "特别声明"]
#: Elements that a page's content may lie in.
CONTAINERS = ["body", "main", "article", "section", "div", "td"]
SPACE = r"[ \t\n\x0B\f\r\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: Comments, raw elements, tags with quoted values, other tags, declarations, texts, and a lone <.
TOKEN = "|".join(
    [
        r"<!--[\s\S]*?(?:-->|\z)",
        r"(?i:<script\b[^>]*>[\s\S]*?(?:</script\s*>|\z))",
        r"(?i:<style\b[^>]*>[\s\S]*?(?:</style\s*>|\z))",
        r"""</?[A-Za-z][^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>""",
        r"</?[A-Za-z!?][^>]*>",
        r"[^<]+",
        r"<",
    ]
)


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


@F.pandas_udf(StringType())
def unescape(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Character references as characters; Spark has no function for the 2,231 names."""
    for part in parts:
        yield part.map(lambda s: entities.unescape(s) if s is not None and "&" in s else s)


def tokens(pages: DataFrame) -> DataFrame:
    """row, page_id, place, token, start, end (code points in the page), tag (lower case, of elements), opens, closes."""
    own = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", F.coalesce("html", F.lit("")).alias("html"))
    parts = own.select("row", "page_id", F.posexplode(F.regexp_extract_all("html", F.lit(TOKEN), F.lit(0))).alias("place", "token"))
    in_page = Window.partitionBy("row").orderBy("place")
    raw = F.col("token").rlike(r"^<!|^(?i:<script\b|<style\b)")
    tag = F.lower(F.regexp_extract("token", r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
    closes = F.col("token").startswith("</")
    own = F.col("token").endswith("/>") | tag.isin(VOID)
    rows = parts.select("*", F.when(~raw & (tag != ""), tag).alias("tag"), raw.alias("raw")).withColumn("end", F.sum(F.length("token")).over(in_page))
    named = F.col("tag").isNotNull()
    return rows.select("row", "page_id", "place", "token", (F.col("end") - F.length("token")).alias("start"), "end", "tag", "raw", (named & ~closes & ~own).alias("opens"), (named & closes).alias("closes"))


def depth(names: list[str], window: object) -> Column:
    """How many elements of these names are open after a token; closing tags of none don't count."""
    step = F.when(F.col("tag").isin(names), F.when(F.col("opens"), 1).when(F.col("closes"), -1)).otherwise(0)
    walk = F.sum(F.coalesce(step, F.lit(0))).over(window)
    return walk


def marked(events: DataFrame) -> DataFrame:
    """Tokens with ``skipped``, ``linked`` and ``block`` (the number of block tags so far), and the ``kind`` and ``level`` that a block tag gives to what follows it."""
    w = Window.partitionBy("row").orderBy("place")
    # A walk that can't go below zero is the walk less its least value so far, if that is below zero.
    out = events.withColumn("s", depth(SKIPPED, w)).withColumn("a", depth(["a"], w))
    out = out.withColumn("skipped", F.col("raw") | (F.col("s") > F.least(F.lit(0), F.min("s").over(w)))).withColumn("linked", F.col("a") > F.least(F.lit(0), F.min("a").over(w)))
    edge = F.coalesce(~F.col("skipped") & F.col("tag").isin([*HEADINGS, *PARAGRAPHS, "li"]), F.lit(False))
    kind = F.when(F.col("opens") & F.col("tag").isin(HEADINGS), "heading").when(F.col("opens") & (F.col("tag") == "li"), "list").otherwise("paragraph")
    level = F.when(kind == "heading", F.substring("tag", 2, 1).cast("int"))
    return out.select(*events.columns, "skipped", "linked", F.sum(edge.cast("int")).over(w).alias("block"), F.when(edge, kind).alias("kind"), F.when(edge, level).alias("level"))


def blocks(pages: DataFrame) -> DataFrame:
    """row, page_id, block, kind (heading, list, paragraph), level, text, chars, link_chars, place (of its first text) of the blocks that have text, elements left out and noise aside.

    Texts of a block are joined without a space between, as they stand; each is trimmed, and a line break is a space.
    """
    return _blocks(marked(tokens(pages)))


def _blocks(events: DataFrame) -> DataFrame:
    text = F.when(F.col("tag") == "br", " ").when(F.col("tag").isNull(), collapse(unescape(F.col("token"))))
    pieces = events.filter("not skipped").select("row", "page_id", "block", "place", "kind", "level", "linked", text.alias("piece"))
    said = F.when(F.col("piece") != "", F.col("piece"))
    grouped = pieces.groupBy("row", "page_id", "block").agg(
        F.max("kind").alias("kind"),
        F.max("level").alias("level"),
        F.sort_array(F.collect_list(F.when(said.isNotNull(), F.struct("place", "piece")))).alias("pieces"),
        F.sum(F.when(F.col("linked") & (F.col("piece") != " "), F.length("piece"))).alias("link_chars"),
        F.min(F.when(F.col("piece") != " ", F.when(said.isNotNull(), F.col("place")))).alias("place"),
    )
    whole = collapse(F.array_join(F.transform("pieces", lambda p: p["piece"]), ""))
    made = grouped.select("row", "page_id", "block", F.coalesce("kind", F.lit("paragraph")).alias("kind"), "level", whole.alias("text"), F.coalesce("link_chars", F.lit(0)).alias("link_chars"), "place")
    return made.filter((F.col("text") != "") & ~F.col("text").rlike("|".join(NOISE))).withColumn("chars", F.length("text").cast("long"))


def containers(events: DataFrame) -> DataFrame:
    """row, first, last (places), nested, chars, link_chars of each element that content may lie in.

    First and last are numbers before and after the element's subtree, and the sums over it are differences of
    running sums there; opening and closing tags of one nesting depth alternate, so the end is the next row of that depth.
    """
    w = Window.partitionBy("row").orderBy("place")
    size = F.when(~F.col("skipped") & F.col("tag").isNull(), F.length(collapse(F.col("token")))).otherwise(0)
    rows = events.select("row", "place", "tag", "opens", "closes", F.sum(size).over(w).alias("sum"), F.sum(F.when(F.col("linked"), size).otherwise(0)).over(w).alias("links"), depth(CONTAINERS, w).alias("walk"))
    page = Window.partitionBy("row")
    rows = rows.withColumn("nested", F.col("walk") - F.least(F.lit(0), F.min("walk").over(w)))
    rows = rows.withColumn("all", F.max("sum").over(page)).withColumn("all_links", F.max("links").over(page)).withColumn("end", F.max("place").over(page) + 1)
    was = F.coalesce(F.lag("nested").over(w), F.lit(0))
    tags = rows.withColumn("was", was).filter(F.col("tag").isin(CONTAINERS) & (F.col("opens") | (F.col("closes") & (F.col("was") > 0))))
    tags = tags.withColumn("at", F.when(F.col("opens"), F.col("nested")).otherwise(F.col("was")))
    same = Window.partitionBy("row", "at").orderBy("place")
    to = lambda c, end: F.coalesce(F.lead(c).over(same), F.col(end))
    ends = tags.select("row", F.col("place").alias("first"), to("place", "end").alias("last"), F.col("at").alias("nested"), (to("sum", "all") - F.col("sum")).alias("chars"), (to("links", "all_links") - F.col("links")).alias("link_chars"), "opens", "all", "all_links")
    return ends.filter("opens").drop("opens")


def main_content(pages: DataFrame, share: float = 0.5, most_links: float = 0.5) -> DataFrame:
    """The blocks of ``blocks`` that are a page's main content, numbered by ``seq``, with ``start`` and ``end`` in the text that ``page_text`` makes of them.

    The content lies in the deepest element, the first of these, that has at least ``share`` of the page's characters outside links;
    in the whole page if there is none.  A block of which more than ``most_links`` are link characters goes.
    """
    events = marked(tokens(pages))
    plain = (F.col("all") - F.col("all_links")) * share
    dense = containers(events).filter((F.col("chars") - F.col("link_chars") >= plain) & (plain > 0))
    best = dense.groupBy("row").agg(F.max(F.struct("nested", (-F.col("first")).alias("first"), "last")).alias("best"))
    rows = _blocks(events).filter(F.col("link_chars") <= most_links * F.col("chars")).join(best, "row", "left")
    return numbered(rows.filter("best is null or (place > -best.first and place < best.last)").drop("best"))


def numbered(rows: DataFrame) -> DataFrame:
    """Blocks with ``line`` (headings with #, list items with -), ``seq`` from 1 on and their place in the text of the page."""
    line = F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce("level", F.lit(2))), F.lit(" "), F.col("text")))
    line = line.when((F.col("kind") == "list") & ~F.col("text").rlike("^[-*] "), F.concat(F.lit("- "), F.col("text"))).otherwise(F.col("text"))
    w = Window.partitionBy("row").orderBy("block")
    out = rows.withColumn("line", line).withColumn("seq", F.row_number().over(w)).withColumn("end", F.sum(F.length("line") + 2).over(w) - 2)
    return out.withColumn("start", F.col("end") - F.length("line"))


def page_text(rows: DataFrame) -> DataFrame:
    """row, page_id, n_blocks, text: the lines of each page's numbered blocks with an empty line between."""
    lines = rows.groupBy("row", "page_id").agg(F.sort_array(F.collect_list(F.struct("seq", "line"))).alias("lines"))
    return lines.select("row", "page_id", F.size("lines").cast("long").alias("n_blocks"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n").alias("text"))


def sections(rows: DataFrame, keys: list[str], default: str = "正文") -> DataFrame:
    """Sections of numbered blocks (keys, seq, kind, level, text, start, end): (keys, section, heading, level, parent, first_seq, last_seq, start, end).

    A section goes from a heading to the next of any level; its parent is the last section before of a lower level.  What
    stands before the first heading is in none; without headings all of it is one section called ``default``.
    """
    by_key = Window.partitionBy(*keys)
    w = by_key.orderBy("seq")
    head = F.col("kind") == "heading"
    known = rows.withColumn("section", F.sum(head.cast("int")).over(w)).withColumn("none", F.max(head.cast("int")).over(by_key) == 0)
    known = known.filter("section > 0 or none").withColumn("section", F.when(F.col("none"), 1).otherwise(F.col("section")))
    first = lambda c: F.min_by(c, "seq").alias(c)
    made = known.groupBy(*keys, "section").agg(F.first("none").alias("none"), first("text"), first("level"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), first("start"), F.max("end").alias("end"))
    made = made.withColumn("level", F.when(F.col("none"), 1).otherwise(F.coalesce("level", F.lit(1))))
    in_order = by_key.orderBy("section")
    above = [F.last(F.when(F.col("level") == n, F.col("section")), ignorenulls=True).over(in_order) for n in range(1, 6)]
    parent = F.greatest(*[F.when(F.col("level") > n, above[n - 1]) for n in range(1, 6)])
    return made.select(*keys, "section", F.when(F.col("none"), default).otherwise(F.substring("text", 1, 120)).alias("heading"), "level", parent.alias("parent"), "first_seq", "last_seq", "start", "end")


# Blocks of marked-down text.
MARKED_HEADING = r"^(#{1,6})[ \t]+(.+)$"
NUMBERED_HEADING = r"^([一二三四五六七八九十]+[、.．]|第[一二三四五六七八九十\d]+[章节篇]|[（(][一二三四五六七八九十\d]+[）)])"
BLANK_LINES = r"\n\s*\n"
TABLE_RULE = r"\n?\|.+\|\n\|?[-:| ]+\|"


def plain(text: Column) -> Column:
    """Without pictures, link targets and marks."""
    out = F.regexp_replace(F.regexp_replace(text, r"!\[[^\]]*]\([^)]+\)", ""), r"\[([^\]]+)]\([^)]+\)", "$1")
    return collapse(F.regexp_replace(out, r"[*_`>#-]+", " "))


def text_blocks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """row, key, seq, kind (heading, list, table, code, paragraph), level, text, start, end of the parts between blank lines, with their places in the text."""
    own = texts.select(F.monotonically_increasing_id().alias("row"), key, F.coalesce(F.col(text), F.lit("")).alias("said"))
    parts = F.arrays_zip(F.split("said", BLANK_LINES).alias("part"), F.concat(F.array(F.lit("")), F.regexp_extract_all("said", F.lit(BLANK_LINES), F.lit(0))).alias("gap"))
    rows = own.select("row", key, F.posexplode(parts).alias("n", "p")).select("row", key, "n", F.col("p")["part"].alias("part"), F.col("p")["gap"].alias("gap"))
    w = Window.partitionBy("row").orderBy("n")
    bare = F.regexp_replace("part", r"^\s+|\s+$", "")
    lead = F.length("part") - F.length(F.regexp_replace("part", r"^\s+", ""))
    rows = rows.withColumn("stop", F.sum(F.length("part") + F.length("gap")).over(w)).select("row", key, "n", bare.alias("bare"), (F.col("stop") - F.length("part") + lead).alias("start")).filter("bare != ''")
    b = F.col("bare")
    emphasis = collapse(F.regexp_replace(F.regexp_replace(b, r"^(\*\*|__)\s*", ""), r"\s*(\*\*|__)$", ""))
    marks = F.regexp_extract(b, MARKED_HEADING, 1)
    short = (F.length(emphasis) <= 80) & (emphasis.rlike(NUMBERED_HEADING) | (b.startswith("**") & b.endswith("**")))
    kind = F.when((marks != "") | short, "heading").when(b.rlike(r"^([-*] |\d+[.)、]\s+)"), "list").when(b.rlike(TABLE_RULE), "table").when(b.startswith("```"), "code").otherwise("paragraph")
    level = F.when(marks != "", F.length(marks)).when(short, 2)
    own = F.when(marks != "", F.trim(F.regexp_extract(b, MARKED_HEADING, 2))).when(short, emphasis).otherwise(plain(b))
    return rows.select("row", key, F.row_number().over(w).alias("seq"), kind.alias("kind"), level.alias("level"), own.alias("text"), "start", (F.col("start") + F.length("bare")).alias("end"))

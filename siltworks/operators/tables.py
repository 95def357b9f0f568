"""Tables and metric cards inside blocks: record tables taken apart row by row, headings that are figures' data.

A table is read with array expressions in the row of its block: lines, header, cells, and a fold over segments that puts rows
which only go on with a cell to the row before. Nothing is shuffled.

Defined cases: null texts and blocks that are no table stay as they are; so do tables whose header has an empty cell, or that no rows
follow; rows of another number of cells than the header, and rows without content, go; the first row is never taken for one that goes on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hints that decide, words of headers that name records, words at the head of a matrix.
ATOMIC_HINTS = ["row_atomic", "record_table", "row_records", "atomic_rows"]
OTHER_HINTS = ["matrix", "cross_tab", "crosstab", "layout", "key_value", "form"]
RECORD_WORDS = [
    "时间", "日期", "发布", "年份", "年度", "部门", "机构", "单位",
    "文件", "名称", "标题", "内容", "摘要", "政策", "法规", "办法",
    "主体", "类型", "类别", "地区", "指标", "数值", "说明", "责任",
    "序号", "编号", "对象", "事项", "措施", "要求",
]
STRONG_WORDS = ["时间", "日期", "发布", "部门", "机构", "文件", "名称", "内容", "摘要", "政策"]
MATRIX_HEADS = ["项目", "类别", "类型", "地区", "指标", "维度", "名称"]
RULE = r"^\|?(\s*:?-{3,}:?\s*\|)*\s*:?-{3,}:?\s*\|?$"
YEAR, NUMBER = r"^\d{4}(年)?$", r"^-?\d+(\.\d+)?$"


def _bare(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _cells(line: Column) -> Column:
    """Cells of a line, white space collapsed, line breaks as slashes."""
    inner = F.regexp_replace(F.regexp_replace(line, r"^\|", ""), r"\|$", "")
    return F.transform(F.split(inner, r"\|"), lambda c: F.regexp_replace(_bare(F.replace(_bare(c), F.lit("<br>"), F.lit(" / "))), r"\s+", " "))


def _named(header: Column, words: list[str]) -> Column:
    return header.rlike("|".join(words))


def _continues(headers: Column, cells: Column) -> Column:
    """Whether a row only goes on: its last cell alone is filled, or nothing before the last of the columns that name records, and these are empty."""
    filled = F.filter(F.transform(cells, lambda c, i: F.when(c != "", i).otherwise(-1)), lambda i: i >= 0)
    naming = F.filter(F.transform(F.slice(headers, F.lit(1), F.size(headers) - 1), lambda h, i: F.when(_named(h, STRONG_WORDS), i).otherwise(-1)), lambda i: i >= 0)
    lone = (F.size(filled) == 1) & (F.array_max(filled) == F.size(cells) - 1)
    unnamed = (F.size(naming) > 0) & F.forall(naming, lambda i: F.get(cells, i) == "")
    return lone | F.coalesce(unnamed & (F.array_min(filled) >= F.array_max(naming)), F.lit(False))


def parse(text: Column) -> Column:
    """struct<headers, rows: array<struct<cells, raw>>> of the first piped table in a text; null if there is none."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), _bare), lambda x: x.contains("|"))
    bind = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  worked out once

    def of(lines: Column) -> Column:
        rules = F.filter(F.transform(lines, lambda x, i: F.when((i > 0) & x.rlike(RULE), i).otherwise(-1)), lambda i: i > 0)
        return F.when((F.size(lines) >= 3) & (F.size(rules) > 0), bind(F.get(rules, F.lit(0)), lambda at: bind(_cells(F.get(lines, at - 1)), lambda h: table(lines, at, h))))

    def table(lines: Column, at: Column, headers: Column) -> Column:
        raw = F.slice(lines, at + 2, F.greatest(F.size(lines) - at - 1, F.lit(0)))
        rows = F.transform(raw, lambda x: F.struct(_cells(x).alias("cells"), x.alias("raw")))
        rows = F.filter(rows, lambda r: (F.size(r["cells"]) == F.size(headers)) & F.exists(r["cells"], lambda c: c != ""))
        marked = F.transform(rows, lambda r, i: F.struct(r["cells"].alias("cells"), r["raw"].alias("raw"), ((i > 0) & _continues(headers, r["cells"])).alias("more")))
        return F.when(F.forall(headers, lambda h: h != ""), bind(marked, lambda m: merged(headers, m)))

    def merged(headers: Column, rows: Column) -> Column:
        starts = F.filter(F.transform(rows, lambda r, i: F.when(r["more"], -1).otherwise(i)), lambda i: i >= 0)

        def whole(start: Column, stop: Column) -> Column:
            part = F.slice(rows, start + 1, stop - start)
            cells = F.transform(headers, lambda h, c: F.array_join(F.filter(F.transform(part, lambda r: F.get(r["cells"], c)), lambda x: x != ""), " "))
            return F.struct(cells.alias("cells"), F.array_join(F.transform(part, lambda r: r["raw"]), "\n").alias("raw"))

        made = bind(starts, lambda s: F.transform(s, lambda a, k: whole(a, F.coalesce(F.get(s, k + 1), F.size(rows)))))
        return F.when(F.size(rows) > 0, F.struct(headers.alias("headers"), made.alias("rows")))

    return bind(lines, of)


def is_matrix(table: Column) -> Column:
    """Years or short names over columns of figures."""
    headers = table["headers"]
    others = F.slice(headers, F.lit(2), F.size(headers))
    value_like = F.size(F.filter(others, lambda h: h.rlike(YEAR) | (F.length(h) <= 4)))
    named = (value_like >= F.greatest(F.lit(3), F.size(others) - 1)) & F.get(headers, F.lit(0)).isin(MATRIX_HEADS)
    cells = F.flatten(F.transform(table["rows"], lambda r: F.slice(r["cells"], F.lit(2), F.size(r["cells"]))))
    numeric = F.size(F.filter(cells, lambda c: F.regexp_replace(c, "[,%]", "").rlike(NUMBER)))
    figures = (F.size(cells) > 0) & (numeric / F.size(cells) >= 0.8) & (value_like >= 2)
    return (F.size(headers) >= 4) & (named | F.coalesce(figures, F.lit(False)))


def is_record_table(table: Column, hint: Column | None = None) -> Column:
    """Three to ten columns, two rows or more, no matrix, and headers that name records; a hint decides before all that."""
    headers = table["headers"]
    hits = lambda words: F.size(F.filter(headers, lambda h: _named(h, words)))
    strong = hits(STRONG_WORDS)
    named = (strong >= 2) | ((F.size(headers) >= 4) & (strong >= 1) & (hits(RECORD_WORDS) >= 2))
    plain = F.size(headers).between(3, 10) & (F.size(table["rows"]) >= 2) & ~is_matrix(table) & named
    said = F.lower(F.trim(F.coalesce(hint if hint is not None else F.lit(None).cast("string"), F.lit(""))))
    return table.isNotNull() & F.when(said.isin(OTHER_HINTS), False).when(said.isin(ATOMIC_HINTS), True).otherwise(plain)


def explode_tables(blocks: DataFrame, default_caption: str = "表格行记录") -> DataFrame:
    """Blocks (doc_id, seq, block_type, text, hint, caption) with record tables taken apart.

    Adds ``row`` (null: a block as it was; 0: the overview that stands for a table; then its rows), ``n_rows``, and ``start`` and ``end`` of a row in
    the block's text, null if its lines don't stand there together.
    """
    read = F.when(F.col("block_type") == "table", parse(F.coalesce("text", F.lit(""))))
    rows = blocks.withColumn("table", read).withColumn("apart", is_record_table(F.col("table"), F.col("hint")))
    size, headers = F.size("table.rows"), F.col("table.headers")
    overview = F.concat(F.lit("表格概览：共 "), size.cast("string"), F.lit(" 条记录；字段："), F.array_join(headers, " / "))
    prefix = F.coalesce(F.nullif(F.trim("caption"), F.lit("")), F.lit(default_caption)) if default_caption else F.trim("caption")

    def said(r: Column) -> Column:
        pairs = F.filter(F.zip_with(headers, r["cells"], lambda h, c: F.when(c != "", F.concat(h, F.lit(": "), c))), lambda p: p.isNotNull())
        return F.concat(prefix, F.lit(" | "), F.array_join(pairs, " | "))

    unit = lambda kind, text, row, at, n: F.struct(kind.alias("block_type"), text.alias("text"), row.alias("row"), at.alias("start"), (at + n).alias("end"))
    none = F.lit(None).cast("int")
    whole = F.array(unit(F.col("block_type"), F.col("text"), none, none, none))
    place = lambda r: F.nullif(F.instr(F.col("text"), r["raw"]) - 1, F.lit(-1))
    apart = F.concat(
        F.array(unit(F.lit("table"), overview, F.lit(0), none, none)),
        F.transform("table.rows", lambda r, i: unit(F.lit("table_row"), said(r), i + 1, place(r), F.length(r["raw"]))),
    )
    units = rows.select("doc_id", "seq", F.when(F.col("apart"), size).alias("n_rows"), F.explode(F.when(F.col("apart"), apart).otherwise(whole)).alias("u"))
    return units.select("doc_id", "seq", "u.*", "n_rows")


# Metric cards: headings that are a figure's data.
METRIC_VALUE = r"(同比\s*(增长|下降|增速)?\s*\d|\d[\d,.]*\s*(万亿元|亿元|万家|家|%|％|倍|个|万人|亿美元|万亿|亿|万))"
METRIC_GROUP = r"(^\s*\d+[、.．]\s*|主要.*数据|核心.*指标|关键.*指标|电商数据|指标)"
SECTION_HEADING = r"^\s*([（(][一二三四五六七八九十]+[）)]|第[一二三四五六七八九十\d]+[章节篇])"


def metric_cards(blocks: DataFrame) -> DataFrame:
    """(doc_id, seq, text, consumed): headings that state a figure, each with the heading of a group right before it, if there is one.

    A run of headings has consecutive seqs, so what stands before one in its run is the row before, and no run is gathered.
    """
    text = _bare(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+", ""), r"^#+", ""))
    w = Window.partitionBy("doc_id").orderBy("seq")
    section = (F.col("said") == "") | F.col("said").rlike(SECTION_HEADING)
    value = F.coalesce(F.col("block_type").isin("heading", "title"), F.lit(False)) & ~section & F.col("said").rlike(METRIC_VALUE)
    group = F.coalesce(F.col("block_type").isin("heading", "title"), F.lit(False)) & ~section & ~F.col("said").rlike(METRIC_VALUE) & F.col("said").rlike(METRIC_GROUP)
    rows = blocks.select("doc_id", "seq", "block_type", text.alias("said")).select("doc_id", "seq", "said", value.alias("value"), group.alias("group"))
    before = F.when(F.lag("group").over(w) & (F.lag("seq").over(w) == F.col("seq") - 1), F.struct(F.lag("seq").over(w).alias("seq"), F.lag("said").over(w).alias("said")))
    cards = rows.withColumn("before", before).filter("value")
    return cards.select(
        "doc_id",
        F.coalesce("before.seq", "seq").alias("seq"),
        F.concat_ws("\n", "before.said", "said").alias("text"),
        F.array_compact(F.array("before.seq", "seq")).alias("consumed"),
    )

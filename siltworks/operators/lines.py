"""Texts read line by line: automata over slices of lines, entries of fields, triples with the blocks that bear them out.

``scan`` runs a finite automaton over lines that may be cut anywhere.  A slice of lines is a map from the state before
it to the state after it and a count; maps of a key's slices are put together one after the other, and each slice then runs from the
state that it is entered in.  A task holds a slice, and of a key one small map for ``SLICE`` lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltworks.operators.ordered import meet, written
from siltworks.operators.trees import overlaps

#: Lines of a key that one array holds.
SLICE = 256
#: Fields of a tag, patterns of a relation, what a relation without a name is called, blocks that bear out a concept.
TAG_FIELDS = ["标签名", "同义词", "分类", "层级", "描述"]
NAMED_RELATION = r"^(.+?)\s*[-—→]+\s*\[(.+?)\]\s*[-—→]+\s*(.+)"
PLAIN_RELATION = r"^(.+?)\s+(?:包含|依赖|先修|对应|应用)\s+(.+)"
RELATED, EVIDENCE = "关联", 5

_bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")


def scan(lines: DataFrame, keys: list[str], order: str, states: int, step: Callable[[Column, Column], tuple[Column, Column]], size: int | None = None) -> DataFrame:
    """Lines (keys, order, more) with ``state``, the state before each, and ``count``, what was emitted before it; state 0 comes first.

    ``step`` (state, line as a struct) gives the next state and how much is emitted, both int.  ``order`` is an integer; ties are taken in any order.
    """
    size = size or SLICE
    rest = [c for c in lines.columns if c not in keys]
    sliced = lines.select(*keys, F.floor(F.col(order) / size).alias("slice_"), F.struct(F.col(order).alias("order_"), *rest).alias("line_"))
    sliced = sliced.groupBy(*keys, "slice_").agg(F.sort_array(F.collect_list("line_")).alias("lines_"))
    begin = lambda s: F.struct(s.cast("int").alias("state"), F.lit(0).cast("long").alias("count"))

    def go(a: Column, line: Column) -> Column:
        to, n = step(a["state"], line)
        return F.struct(to.cast("int").alias("state"), (a["count"] + n).alias("count"))

    maps = F.transform(F.sequence(F.lit(0), F.lit(states - 1)), lambda s: F.aggregate("lines_", begin(s), go))
    by_key = sliced.select(*keys, "slice_", maps.alias("map_")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("slice_", "map_"))).alias("maps_"))
    seen = "array<struct<slice_: bigint, state: int, count: bigint>>"

    def through(a: Column, m: Column) -> Column:
        end = F.get(m["map_"], a["state"])
        here = F.struct(m["slice_"].alias("slice_"), a["state"].alias("state"), a["count"].alias("count"))
        return F.struct(end["state"].alias("state"), (a["count"] + end["count"]).alias("count"), F.array_append(a["all"], here).alias("all"))

    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("count"), F.array().cast(seen).alias("all"))
    entered = by_key.select(*keys, F.explode(F.aggregate("maps_", start, through, lambda a: a["all"])).alias("e")).select(*keys, F.col("e.slice_").alias("slice_"), F.struct("e.state", "e.count").alias("from_"))
    known = meet(sliced, entered, [*keys, "slice_"])
    out = F.array().cast("array<struct<state: int, count: bigint>>")

    def walk(a: Column, line: Column) -> Column:
        return F.struct(go(a["at"], line).alias("at"), F.array_append(a["all"], a["at"]).alias("all"))

    walked = known.withColumn("at_", F.aggregate("lines_", F.struct("from_", out.alias("all")).cast("struct<at: struct<state: int, count: bigint>, all: array<struct<state: int, count: bigint>>>"), walk, lambda a: a["all"]))
    each = walked.select(*keys, F.explode(F.arrays_zip("lines_", "at_")).alias("x"))
    return each.select(*keys, *[F.col("x.lines_")[c].alias(c) for c in rest], F.col("x.at_.state").alias("state"), F.col("x.at_.count").alias("count"))


def entries(lines: DataFrame, fields: list[str] = TAG_FIELDS, size: int | None = None) -> DataFrame:
    """(doc_id, entry, name, fields: map) of lines (doc_id, seq, line): lines between blank ones are an entry, numbered from 0.

    A line ``field: value`` gives a field, the last of that field counts; any other first line of an entry is its name, later ones don't count. Null lines are blank.
    """
    rows = lines.select("doc_id", F.col("seq").cast("long").alias("seq"), _bare(F.coalesce("line", F.lit(""))).alias("line"))
    # 0: outside an entry, 1: inside; an entry is emitted as it opens.
    scanned = scan(rows, ["doc_id"], "seq", 2, lambda s, x: (F.when(x["line"] == "", 0).otherwise(1), F.when((s == 0) & (x["line"] != ""), 1).otherwise(0)), size)
    said = scanned.filter("line != ''").withColumn("first", F.col("state") == 0).withColumn("entry", F.col("count") - F.when(F.col("first"), 0).otherwise(1))
    found = F.lit(None).cast("struct<field: string, value: string>")
    for f in reversed(fields):
        value = F.regexp_extract("line", rf"^\Q{f}\E\s*[:：]\s*(.+)", 1)
        found = F.when(value != "", F.struct(F.lit(f).alias("field"), F.trim(value).alias("value"))).otherwise(found)
    plain = F.when(F.col("first"), F.struct(F.lit(fields[0]).alias("field"), F.col("line").alias("value")))
    given = said.select("doc_id", "entry", "seq", F.coalesce(found, plain).alias("g")).filter("g is not null")
    last = given.groupBy("doc_id", "entry", "g.field").agg(F.max_by("g.value", "seq").alias("value"))
    made = last.groupBy("doc_id", "entry").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("fields"))
    name = F.coalesce(F.try_element_at("fields", F.lit(fields[0])), F.concat(F.lit("tag_"), F.col("entry").cast("string")))
    return made.select("doc_id", "entry", name.alias("name"), "fields")


def triples(texts: DataFrame) -> DataFrame:
    """(doc_id, n, subject, predicate, object, start, end): relations stated by lines of texts (doc_id, text), with the place of the line (code points); ``n`` from 0 on within a text.

    Without a name a relation is called ``RELATED``.  Null texts have none.  Rows of one doc_id are texts of their own.
    """
    own = texts.filter("text is not null").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = F.split("text", "\n")
    # Where a line begins is the length of all before it and of their ends.
    ends = F.aggregate(F.transform(parts, F.length), F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n + 1))
    lines = own.select("row", "doc_id", F.posexplode(F.arrays_zip(parts.alias("line"), F.slice(ends, F.lit(1), F.size(parts)).alias("start"))).alias("k", "x")).select("row", "doc_id", "k", "x.*")
    s = _bare(F.col("line"))
    named, plain = F.regexp_extract(s, NAMED_RELATION, 1) != "", F.regexp_extract(s, PLAIN_RELATION, 1) != ""
    part = lambda k: F.when(named, F.regexp_extract(s, NAMED_RELATION, k))
    subject = F.coalesce(part(1), F.regexp_extract(s, PLAIN_RELATION, 1))
    object_ = F.coalesce(part(3), F.regexp_extract(s, PLAIN_RELATION, 2))
    found = lines.filter(named | plain).select("row", "doc_id", "k", _bare(subject).alias("subject"), F.coalesce(_bare(part(2)), F.lit(RELATED)).alias("predicate"), _bare(object_).alias("object"), "start", (F.col("start") + F.length("line")).alias("end"))
    return found.select("doc_id", F.col("k").alias("n"), "subject", "predicate", "object", "start", "end")


def with_evidence(found: DataFrame, blocks: DataFrame, most: int = EVIDENCE, width: int = 512) -> DataFrame:
    """Adds ``primary`` and ``evidence``, arrays of block_id, from blocks (doc_id, block_id, seq, text, start, end).

    Primary blocks overlap the line.  Evidence are the first ``most`` other blocks, by seq, that mention the subject, then the first others that mention the object.
    Span pairs come from an equi-join on cells.  A document's blocks meet its distinct concepts once, where its rows lie; a block that
    holds one goes on as its number alone, and of those only as many as a concept can need, which is ``2 * most`` and its primary ones.
    """
    keyed = written(found.withColumn("id_", F.struct("n", "start", "subject", "predicate", "object")))
    spans = keyed.select("doc_id", "id_", F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    placed = blocks.select("doc_id", "block_id", "seq", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    first = lambda *c: F.transform(F.sort_array(F.collect_set(F.struct(*c))), lambda x: x["block_id"])
    primary = overlaps(placed, spans, "doc_id", width).groupBy("doc_id", "id_").agg(first("seq", "block_id").alias("primary"))
    empty = F.array().cast("array<string>")
    rows = written(keyed.join(primary, ["doc_id", "id_"], "left").withColumn("primary", F.coalesce("primary", empty)))
    concepts = rows.select("doc_id", F.size("primary").alias("taken_"), F.explode(F.array("subject", "object")).alias("c_")).filter("c_ != ''")
    concepts = concepts.groupBy("doc_id", "c_").agg((F.max("taken_") + 2 * most).alias("need_"))
    said = blocks.filter("block_id is not null").select("doc_id", F.struct("seq", "block_id").alias("block_"), F.coalesce("text", F.lit("")).alias("said_"))
    asked = concepts.withColumnRenamed("doc_id", "asked_")
    held = said.join(asked, (F.col("doc_id") == F.col("asked_")) & F.contains("said_", "c_")).select("doc_id", "c_", "need_", "block_")
    nth = F.dense_rank().over(Window.partitionBy("doc_id", "c_").orderBy("block_"))
    hits = held.withColumn("nth_", nth).filter("nth_ <= need_").groupBy("doc_id", "c_").agg(F.sort_array(F.collect_set("block_")).alias("hits_"))

    def mention(rows: DataFrame, concept: str, seen: Column, name: str) -> DataFrame:
        """The first ``most`` blocks of a concept that weren't seen."""
        met = rows.join(hits.withColumnRenamed("c_", concept), ["doc_id", concept], "left")
        others = F.filter("hits_", lambda b: ~F.array_contains(seen, b["block_id"]))
        return met.withColumn(name, F.coalesce(F.transform(F.slice(others, 1, most), lambda b: b["block_id"]), empty)).drop("hits_")

    rows = mention(rows, "subject", F.col("primary"), "by_subject")
    rows = mention(rows, "object", F.concat("primary", "by_subject"), "by_object")
    return rows.select(*found.columns, "primary", F.concat("by_subject", "by_object").alias("evidence"))


#: What begins a step, and fields of an indicator.
STEP_MARKS = ["步骤", "阶段", "Step"]
INDICATOR_FIELDS = ["维度", "指标", "权重", "评分标准"]


def _offset_lines(texts: DataFrame) -> DataFrame:
    """row, doc_id, k, line, start (code points) of texts (doc_id, text); rows of one doc_id are texts of their own."""
    own = texts.filter("text is not null").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = F.split("text", "\n")
    ends = F.aggregate(F.transform(parts, F.length), F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n + 1))
    return own.select("row", "doc_id", F.posexplode(F.arrays_zip(parts.alias("line"), F.slice(ends, F.lit(1), F.size(parts)).alias("start"))).alias("k", "x")).select("row", "doc_id", "k", "x.*")


def paragraphs(texts: DataFrame) -> DataFrame:
    """(doc_id, n, content, start, end): what stands between empty lines, trimmed, with its place; ``n`` counts those that aren't blank, from 0 on."""
    own = texts.filter("text is not null").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = F.split("text", "\n\n")
    ends = F.aggregate(F.transform(parts, F.length), F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n + 2))
    rows = own.select("row", "doc_id", F.posexplode(F.arrays_zip(parts.alias("raw"), F.slice(ends, F.lit(1), F.size(parts)).alias("at"))).alias("k", "x")).select("row", "doc_id", "k", "x.*")
    content = _bare(F.col("raw"))
    begin = F.col("at") + F.length("raw") - F.length(F.regexp_replace("raw", r"^\s+", ""))
    kept = rows.filter(content != "")
    n = F.row_number().over(Window.partitionBy("row").orderBy("k")) - 1
    return kept.select("doc_id", n.alias("n"), content.alias("content"), begin.alias("start"), (begin + F.length(content)).alias("end"))


def indicators(texts: DataFrame, fields: list[str] = INDICATOR_FIELDS, size: int | None = None) -> DataFrame:
    """(doc_id, n, content, start, end): entries of ``field: value`` lines between blank lines, each written out as its fields, with the place of its first to its last such line.

    Lines without a field don't count, and an entry without any isn't one; ``n`` numbers the stretches between blank lines.  A text without entries gives its paragraphs.  Null texts give nothing.
    """
    rows = _offset_lines(texts).select("row", "doc_id", F.col("k").cast("long").alias("k"), _bare(F.col("line")).alias("said"), "start", (F.col("start") + F.length("line")).alias("end"))
    step = lambda s, x: (F.when(x["said"] == "", 0).otherwise(1), F.when((s == 0) & (x["said"] != ""), 1).otherwise(0))
    scanned = scan(rows, ["row"], "k", 2, step, size).withColumn("n", F.col("count") - F.when(F.col("state") == 0, 0).otherwise(1))
    found = F.lit(None).cast("struct<field: string, value: string>")
    for f in reversed(fields):
        value = F.regexp_extract("said", rf"^\Q{f}\E\s*[:：]\s*(.+)", 1)
        found = F.when(value != "", F.struct(F.lit(f).alias("field"), _bare(value).alias("value"))).otherwise(found)
    given = scanned.withColumn("g", found).filter("g is not null")
    # A field keeps its first place and its last value.
    each = given.groupBy("row", "doc_id", "n", "g.field").agg(F.min("k").alias("at"), F.max_by("g.value", "k").alias("value"), F.min("start").alias("start"), F.max("end").alias("end"))
    lines_ = F.transform(F.sort_array(F.collect_list(F.struct("at", "field", "value"))), lambda x: F.concat(x["field"], F.lit(": "), x["value"]))
    made = each.groupBy("row", "doc_id", "n").agg(F.array_join(lines_, "\n").alias("content"), F.min("start").alias("start"), F.max("end").alias("end"))
    with_any = F.exists(F.split("text", "\n"), lambda x: _bare(x).rlike("^(" + "|".join(rf"\Q{f}\E" for f in fields) + r")\s*[:：]\s*.+"))
    plain = paragraphs(texts.filter(~with_any)).select("doc_id", F.col("n").cast("long").alias("n"), "content", "start", "end")
    return made.select("doc_id", "n", "content", "start", "end").unionByName(plain)


def steps(texts: DataFrame, marks: list[str] = STEP_MARKS) -> DataFrame:
    """(doc_id, n, title, content): what follows each mark of a step at the beginning of a line, up to the next; a text without steps gives its paragraphs, titled by number."""
    some = "|".join(rf"\Q{m}\E" for m in marks)
    pattern = rf"(?s)(?:^|\n)\s*(?:({some})\s*\d*[:：.、]?\s*)(.*?)(?=\n\s*(?:{some})\s*\d*[:：.、]|\z)"
    side = lambda k: F.regexp_extract_all("text", F.lit(pattern), F.lit(k))
    pairs = F.zip_with(side(1), side(2), lambda t, c: F.struct(_bare(t).alias("title"), _bare(c).alias("content")))
    rows = texts.filter("text is not null").withColumn("steps_", F.filter(pairs, lambda p: p["content"] != ""))
    made = rows.filter(F.size("steps_") > 0).select("doc_id", F.posexplode("steps_").alias("n", "s")).select("doc_id", "n", "s.*")
    plain = paragraphs(rows.filter(F.size("steps_") == 0).select("doc_id", "text"))
    return made.unionByName(plain.select("doc_id", "n", F.concat(F.lit("段落"), (F.col("n") + 1).cast("string")).alias("title"), "content"))

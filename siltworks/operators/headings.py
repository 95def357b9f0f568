"""Headings: bare chapter numbers joined with the title that follows, and chunks lifted to the heading they lie under."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A chapter number without a title, and how far off its title may be.
BARE_CHAPTER = r"^(?:项目\s?[一二三四五六七八九十百千万\d]+|第[一二三四五六七八九十百千万\d]+章|单元\s?[一二三四五六七八九十百千万\d]+|模块\s?[一二三四五六七八九十百千万\d]+)$"
MERGE_DISTANCE = 3


def merge_chapters(headings: DataFrame, most: int = MERGE_DISTANCE) -> DataFrame:
    """Headings (doc_id, idx, block_index, label, text) with a bare chapter number and the chapter after it as one; ``merged`` tells which.

    A pair is used up, so of a run of headings that could each take the next, those at even places do: they are told by their distance from the last
    heading that can't, not by a walk.  Null labels and texts are those of no chapter; idx orders a document's headings and is unique there.
    """
    w = Window.partitionBy("doc_id").orderBy("idx")
    text = F.trim(F.coalesce("text", F.lit("")))
    able = (F.col("label") == "chapter") & (F.lead("label").over(w) == "chapter") & text.rlike(BARE_CHAPTER) & (F.lead("block_index").over(w) - F.col("block_index") <= most)
    rows = headings.withColumn("able_", F.coalesce(able, F.lit(False))).withColumn("at_", F.row_number().over(w)).withColumn("next_", F.lead(text).over(w))
    stop = F.coalesce(F.max(F.when(~F.col("able_"), F.col("at_"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("merged", F.col("able_") & ((F.col("at_") - stop) % 2 == 1))
    rows = rows.withColumn("used_", F.coalesce(F.lag("merged").over(w), F.lit(False))).filter("not used_")
    joined = F.when(F.col("merged"), F.concat(text, F.lit(" "), F.col("next_"))).otherwise(F.col("text"))
    return rows.withColumn("text", joined).drop("able_", "at_", "next_", "used_")


def title_key(title: Column) -> Column:
    """A title without white space and punctuation, lower case."""
    return F.lower(F.regexp_replace(title, r"[\s，,。.:：；;、]", ""))


def lift(chunks: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, target): the target (doc_id, title, target) of the deepest title in a chunk's path (doc_id, chunk_id, path) that only one target of the document has.

    Targets are counted before the join, with a sum in each task, so a title that many have is one row and then none.  Chunks without such a title are left out.
    """
    keyed = targets.select("doc_id", title_key(F.col("title")).alias("key"), "target").filter("key != ''")
    single = keyed.groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.min("target").alias("target")).filter("n = 1").drop("n")
    titles = chunks.select("doc_id", "chunk_id", F.posexplode("path").alias("depth", "title")).select("doc_id", "chunk_id", "depth", title_key(F.col("title")).alias("key")).filter("key != ''")
    return titles.join(single, ["doc_id", "key"]).groupBy("doc_id", "chunk_id").agg(F.max_by("target", "depth").alias("target"))

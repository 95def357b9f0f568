"""The corpus pipeline: language ID, near-dedup, substring dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on every row of ``docs`` and returns the
rows that go on.  All but the last return the columns of ``docs``.

Defined cases, for every stage: other columns pass through, whatever their names,
unless they are called like the columns that the last stage adds, which then
replace them; a row without doc_id can't be told from others and goes; repeated rows
of one doc_id are judged alike, and the near-dedup keeps one of them; empty tables
give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm import decontaminate, language_id, mixing, near_dedup, substring_dedup
from siltworks.llm.common import cut, table


def _only(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of ``docs`` whose doc_id is (or, left_anti, isn't) among ``ids``."""
    chosen = ids.select(F.col("doc_id").alias("_chosen_id")).distinct()
    return docs.join(chosen, docs["doc_id"] == chosen["_chosen_id"], how)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known well enough; the rejected go, those with nothing to judge by among them."""
    languages, learnt = language_id.learn(language_id.labelled(docs))
    found = language_id.identify(language_id.of_documents(docs), languages, learnt)
    return _only(docs, found.filter("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies."""
    return _only(docs, near_dedup.near_duplicates(docs).filter("kept")).dropDuplicates(["doc_id"])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; n_chars follows; documents of which nothing is left go."""
    out = substring_dedup.remove(docs, substring_dedup.repeated_passages(docs), drop_emptied=True)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else out


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no near copy of a benchmark item."""
    return _only(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ``rate`` and the ``copies`` of them that a pass over the mixture holds; those of no copies go.

    The copies are the rate rounded up or down: up for the share of documents, by
    the hash of doc_id, that the rate's fraction says.
    """
    rates = mixing.mix(docs, table(spark, sf_dir, "labels")).select(F.col("doc_id").alias("_chosen_id"), "rate").dropDuplicates(["_chosen_id"])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    plain = docs.drop("rate", "copies")
    joined = plain.join(rates, plain["doc_id"] == rates["_chosen_id"]).drop("_chosen_id")
    return joined.withColumn("copies", F.floor(F.col("rate") + draw).cast("int")).filter("copies > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_languages),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontaminate", drop_benchmark),
    ("mixing", mix_sources),
]
#: SQL can't express the learnt stages; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

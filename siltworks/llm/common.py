"""Small shared pieces: word columns, table reading, lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators: 0x20 and 0x09-0x0D.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
SPACE_CHARS = " \t\n\x0b\f\r"
#: Spark's setting by which the shuffles of an execution go with its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write a table to the shared checkpoint folder and read it.

    The folder is the one set on the context or in the session's
    ``spark.checkpoint.dir``; where neither exists, a session in one process (``local[n]``)
    gets a temporary one, and a session on a cluster an error, as executors don't see
    each other's folders.  A written table, unlike ``checkpoint()``, carries no constraints
    of the plan before it, which grow with every round of an iterative join.  The tables stay
    until the cluster clears that folder: the returned frame may be read at any time.  What was
    shuffled for the table is of no more use then and goes with the end of the write, not when
    the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        folder = context.getCheckpointDir()
    path = f"{folder}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)

"""Secrets in whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.functions import clean


def test_secrets_are_scrubbed_in_whole_texts(spark):
    key = "a1B2-c3D4_" * 2
    rows = [("x" * 5000 + f" SK-{key} end",), (f"ragflow-{key}",), (f"bearer\t{key}",), ("sk-short Bearer short",), (None,)]
    got = [r.x for r in spark.createDataFrame(rows, "t string").select(clean.scrub_secrets(F.col("t")).alias("x")).collect()]
    assert got == ["x" * 5000 + " ***redacted*** end", "***redacted***", "***redacted***", "sk-short Bearer short", None]
    cut = spark.createDataFrame(rows[:1], "t string").select(clean.scrub_secrets(F.col("t"), 2000).alias("x")).first().x
    assert cut == "x" * 1986 + "...[truncated]"

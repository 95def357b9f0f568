"""The forms of a text that the rules on noise read are made once, not for each pattern."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.functions import noise


def test_forms_are_made_once(spark):
    rows = spark.createDataFrame([("paragraph", " Contents \n", None, 1, None, None), (None, "一句 话 有 内容", None, 9, None, False), ("image", None, "A1", 1, 10.0, False)], "kind string, text string, caption string, page long, area double, decorative boolean")
    found = rows.select(noise.dropped(*[F.col(c) for c in rows.columns]).alias("why"))
    assert [r.why for r in found.collect()] == ["metadata", None, "empty_media"]
    assert found._jdf.queryExecution().analyzed().toString().count("regexp_replace") <= 5

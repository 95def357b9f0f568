"""What a guarded plan refuses, and edge cases of operators on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siltworks.functions import clean
from siltworks.operators.ranking import combine
from siltworks.operators.packing import pack
from siltworks.operators.trees import descendants, overlaps
from siltworks.operators.vectors import cosine
from siltworks.plans.guard import Plan, PlanError, run
from siltworks.queries.structured import ORDERS
from siltworks.sources.readers import read_csv, read_json
from siltworks.streaming.events import sliding


@pytest.mark.parametrize(
    "plan",
    [
        Plan(filters={"secret": 1}),
        Plan(group_by=("price",)),
        Plan(metrics=("sum:secret",)),
        Plan(order_by=(("secret", "asc"),)),
        Plan(tags={"topic": ["x"]}),
        Plan(limit=0),
        Plan(limit=201),
        Plan(offset=-1),
    ],
)
def test_plans_outside_the_profile_are_refused(spark, plan):
    with pytest.raises(PlanError):
        run(plan, ORDERS, spark.range(0))


def test_groups_keep_null_keys_and_null_metrics_are_zero(spark):
    rows = spark.createDataFrame([(1, "O", None, None, "A"), (2, "O", "x", 2.5, "A")], "o_orderkey long, o_orderstatus string, o_orderpriority string, o_totalprice double, c_mktsegment string")
    got = run(Plan(group_by=("priority",), metrics=("sum:price",)), ORDERS, rows).collect()
    assert [tuple(r) for r in got] == [("x", 2.5, 1), (None, 0.0, 1)]


def test_pack_is_greedy_with_overlap(spark):
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate([40, 40, 40, 200, 10])] + [(2, 0, None)], "k long, i long, n long")
    got = {(r.k, r.unit): (r.n_rows, r.total, r.first, r.last) for r in pack(rows, "k", "i", "n", 100, 10, 1).collect()}
    assert got == {(1, 0): (2, 80, 0, 1), (1, 1): (2, 80, 1, 2), (1, 2): (2, 240, 2, 3), (1, 3): (2, 210, 3, 4), (2, 0): (1, 0, 0, 0)}


def test_cycles_end_at_the_depth(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")], "parent string, child string")
    got = {r.node: r.level for r in descendants(edges, spark.sql("SELECT 'a' AS node"), 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_span_pairs_come_once(spark):
    b = spark.createDataFrame([(1, 0, 1000), (1, 999, 1001), (2, 0, 5)], "k long, b_start long, b_end long")
    s = spark.createDataFrame([(1, 5, 995), (1, 1000, 1002), (2, 5, 9)], "k long, s_start long, s_end long")
    got = sorted((r.b_start, r.s_start) for r in overlaps(b, s, "k", 10).collect())
    assert got == [(0, 5), (999, 1000)]


def test_optional_buckets_that_are_empty_mean_no_filter(spark):
    hits = spark.createDataFrame([("x", 1, 1.0)], "bucket string, id long, score double")
    assert combine(hits, "AND", ["none"], optional=frozenset({"none"})) is None
    assert combine(hits, "AND", ["x", "none"]).count() == 0
    assert combine(hits, "OR", ["x", "none"]).count() == 1


def test_cosine_of_odd_vectors_is_zero(spark):
    rows = spark.sql("SELECT * FROM VALUES (array(1D, 0D), array(1D, 0D)), (array(0D), array(1D)), (array(1D), array(1D, 2D)), (cast(array() AS array<double>), cast(array() AS array<double>)) AS t(x, y)")
    assert [r[0] for r in rows.select(cosine(F.col("x"), F.col("y"))).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_fake_embedding(spark):
    import hashlib

    digest = hashlib.sha256("héllo".encode()).digest()
    got = spark.sql("SELECT 'héllo' AS t").select(clean.fake_embedding(F.col("t"), 40).alias("v")).first().v
    assert got == [round(digest[i % 32] / 255, 6) for i in range(40)]


def test_readers(spark, tmp_path):
    (tmp_path / "x.csv").write_text("序号,name,n\n1,a,\n2,,5\n")
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "x.csv")).collect()] == [("a", None), (None, "5")]
    (tmp_path / "x.json").write_text('{"rows": [{"a": 1, "b": {"c": 2}}, {"a": null}]}')
    assert [tuple(r) for r in read_json(spark, str(tmp_path / "x.json"), "rows").collect()] == [(1, '{"c":2}'), (None, None)]


def test_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = sliding(stream, "1 hour", None).writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.sql("SELECT * FROM hours").collect())) == sorted(map(str, sliding(events, "1 hour", None).collect()))

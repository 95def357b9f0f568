"""The stages of the pipeline on planted documents and on the small tables."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_columns_and_only_drop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        after = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(after) == len(set(after)) and set(after) <= before, name
        if name != "mixing":
            assert docs.columns == COLUMNS, name
            assert len(after) > 0.5 * len(before), name
        before = set(after)
    assert docs.filter("copies < 1 or rate <= 0").count() == 0


def test_planted_copies_and_benchmark_texts_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter(F.length("text") > 100).orderBy("item_id").first().text
    model = docs.filter("n_chars between 600 and 900 and lang = 'en'").orderBy("doc_id").first()
    extra = spark.createDataFrame([(10**6, model.text, "en", "s", model.n_chars), (10**6 + 1, "A text with " + item, "en", "s", 10), (10**6 + 2, None, None, None, None)], docs.schema)
    all_ = docs.unionByName(extra)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, all_, SF).collect()}
    assert 10**6 not in kept
    assert 10**6 + 1 not in {r.doc_id for r in corpus_pipeline.drop_benchmark(spark, all_, SF).collect()}
    assert 10**6 + 2 not in {r.doc_id for r in corpus_pipeline.keep_languages(spark, all_, SF).collect()}


def test_empty_documents(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name


def test_clashing_columns_pass(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit("mine") for c in ("kept", "spans", "tokens", "words", "node", "chosen_id")})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert set(docs.columns) <= set(out.columns), name
        assert out.filter("kept <> 'mine'").count() == 0, name

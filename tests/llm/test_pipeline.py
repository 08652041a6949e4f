"""Every stage on small tables: columns, what stays and what goes, and the whole run."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == columns, name
        assert {r[0] for r in after.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}
        before = after
    # clean prose stays: of documents labelled good, all but short ones and copies
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").select("doc_id")
    long = docs.join(labels, "doc_id").filter(F.size(F.split("text", r"\s+")) >= 60).dropDuplicates(["text"])
    assert before.join(long, "doc_id", "left_semi").count() >= 0.85 * long.count()
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").isEmpty()


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0

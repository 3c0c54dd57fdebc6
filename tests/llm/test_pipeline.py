"""The pipeline's stages, one by one, against what they stand for."""

import os

import pytest

import corpus_pipeline
from strandflow.llm import decontaminate, line_dedup, ngram_jaccard

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, before = docs.columns, docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, DIR).write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        if name == "quality classifier":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
            kept = {r.doc_id for r in after.collect()}
            assert all(d in kept for d, q in labels.items() if q)
        elif name == "line dedup":
            assert after.count() == before.count()
            assert line_dedup.dedup(after).where("n_dropped > 0").count() == 0
            assert after.where("n_chars <> length(text)").count() == 0
        elif name == "n-gram Jaccard join":
            assert ngram_jaccard.join(after).where("doc_id <> component_id").count() == 0
        elif name == "benchmark decontamination":
            assert decontaminate.judge(after, spark.read.parquet(f"{DIR}/benchmark.parquet")).where("contaminated").count() == 0
        else:
            assert after.count() == before.count() and "ids_sha256" in after.columns
        if i < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns
        before = after
    ours = corpus_pipeline.run(spark, DIR)
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, before.collect()))

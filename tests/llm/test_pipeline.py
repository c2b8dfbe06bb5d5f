"""The pipeline's stages one after the other on the smallest tables."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        left = {r.doc_id for r in now.select("doc_id").collect()}
        assert left and left <= ids
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns
        docs, ids = now, left
    assert {"n_tokens", "ids"} <= set(docs.columns)


def test_run_equals_stages_and_takes_an_empty_table(spark, tmp_path):
    out = corpus_pipeline.run(spark, SF)
    assert out.where("not lossless").count() == 0
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0 if t == "documents" else 50).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

"""The pipeline's stages, one after the other, on the smallest table and on an empty one."""

import os

import pytest

import corpus_pipeline
from dutyweave.llm import queries
from dutyweave.staging import stage

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        docs = stage(step(spark, docs, SF), "test")
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert counts[1] >= 0.98 * counts[0] and counts[3] <= counts[2] <= counts[1] and counts[5] == counts[4] > 0
    assert docs.where("NOT lossless").count() == 0


def test_stages_on_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF), "test")
    assert docs.count() == 0


def test_every_operator_is_registered():
    names = queries.queries()
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)

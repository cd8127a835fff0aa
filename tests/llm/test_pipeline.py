"""The pipeline's stages, each against what it must do to its own input."""

import corpus_pipeline
from pulseframe.llm.base import table

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = table(spark, SMALL, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).checkpoint()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert mixed.columns == [*columns, "copy"]
    assert mixed.join(docs.select("doc_id"), "doc_id", "left_anti").count() == 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_table(spark):
    docs = table(spark, SMALL, "documents").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0

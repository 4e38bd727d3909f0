import pytest

import corpus_pipeline
from raysheaf.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_stages_work_on_what_is_left(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    counts = [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, SF), name)
        counts.append(docs.count())
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= set(before)
    assert counts[0] > counts[1] > counts[2] >= counts[3] and counts[4] == counts[5] > 0


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, stage):
    docs = written(table(spark, SF, "documents").limit(0), "none")
    assert stage(spark, docs, SF).count() == 0


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_nulls_repeats_and_clashing_columns(spark, stage):
    docs = table(spark, SF, "documents").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "a b c", None, None, 5), (900001, "", "en", None, 0), (900002, None, None, "s", None), (900003, "word " * 30_000, "en", "s", 1)], docs.schema)
    rows = docs.unionByName(odd).unionByName(docs.limit(3)).unionByName(odd)
    rows = written(rows.selectExpr("*", "1L AS size", "'x' AS digest", "2 AS node", "3 AS row", "4.0 AS target", "5 AS root"), "odd")
    found = stage(spark, rows, SF)
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert found.columns == rows.columns
    assert 0 < found.count() <= 3 * rows.count()

"""The registered queries against their SQL, and the pipeline end to end."""

from __future__ import annotations

import pytest
from check_oracles import compare, connect

import corpus_pipeline
from coordloom.llm.oracles import LLM_ORACLES
from coordloom.llm.queries import LLM_QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES) == list(range(1, 14))
    assert set(LLM_ORACLES) <= set(LLM_QUERIES)


@pytest.mark.parametrize("name", list(LLM_ORACLES))
def test_query_equals_sql(spark, con, name):
    got, want = LLM_QUERIES[name](spark, SF_DIR).toPandas(), con.execute(LLM_ORACLES[name]).df()
    nulls = {c: v for c, v in (("rule", "none"), ("form", "none"), ("form_n", -1)) if c in got}
    got, want = got.fillna(nulls), want.fillna(nulls)
    assert compare(got, want) is None


@pytest.mark.parametrize("name", [n for n in LLM_QUERIES if n not in LLM_ORACLES])
def test_other_queries_have_rows(spark, name):
    assert LLM_QUERIES[name](spark, SF_DIR).count() > 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF_DIR).toPandas())
        assert docs.columns == before and 0 < docs.count() <= n, name
        n = docs.count()
    quality = spark.read.parquet(f"{SF_DIR}/labels.parquet").join(docs, "doc_id")
    assert quality.filter("quality = 0").count() == 0 < quality.filter("quality = 1").count()
    got = corpus_pipeline.run(spark, SF_DIR).toPandas()
    assert set(got.doc_id) == {r.doc_id for r in docs.select("doc_id").collect()}
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum()[:-1]] and own.length.sum() <= 2048

"""The stages of the pipeline on odd tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = {"a.b": 1, "own": "o", "score": 0.5, "block": 3, "n_words": 4, "key": "k", "kept": "x", "node": 7,
         "component": 1, "size": 2, "n": 9}


def odd_table(spark):
    """Null keys and texts, empty and very long texts, repeated rows, clashing columns."""
    real = spark.read.parquet(f"{SF_DIR}/documents.parquet").select(*(f.split()[0] for f in SCHEMA.split(", ")))
    text = real.filter("length(text) > 2000").orderBy("doc_id").first()["text"]
    rows = [(None, text, "en", None, 5), (None, None, None, None, None), (900_001, "", "en", "s", 0),
            (900_002, None, "en", "s", 0), (900_003, text, "en", "s", 1), (900_003, text, "en", "s", 1),
            (900_003, text + " more", "en", "s", 1), (900_004, (text + " ") * 40, "en", "s", 1)]
    odd = spark.createDataFrame(rows, SCHEMA)
    return real.select(*(F.col(c).cast(t) for c, t in (f.split() for f in SCHEMA.split(", ")))).unionByName(
        odd).select("*", *(F.lit(v).alias(c) for c, v in EXTRA.items())).coalesce(4)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_of_an_odd_table(spark, name, stage):
    docs = odd_table(spark)
    got = stage(spark, docs, SF_DIR)
    rows = got.collect()
    assert rows
    if stage is corpus_pipeline.STAGES[-1][1]:
        return
    assert got.columns == docs.columns and len(rows) <= docs.count()
    assert all(r[c] == v for r in rows for c, v in EXTRA.items())


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_of_an_empty_table(spark, name, stage):
    docs = odd_table(spark).limit(0)
    got = stage(spark, docs, SF_DIR)
    assert got.collect() == []
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert got.columns == docs.columns

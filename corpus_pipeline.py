"""From raw documents to packed training sequences, in five stages.

Every stage works on all that the one before kept. ``run`` writes what a stage returns to
the shared folder as Parquet and reads it back as the next stage's documents, so a lost
executor costs one stage's work at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from coordloom.llm import jaccard, packing, quality_rules, rule_ensemble, substring
from coordloom.llm.queries import VOCABULARY
from coordloom.session import cut, new_folder, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learned from ``labels``, accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = rule_ensemble.fit(rule_ensemble.training_rows(docs, labels))
    return rule_ensemble.accepted(docs, model)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the newest policy over the rule ledger keeps."""
    return quality_rules.kept(docs, quality_rules.POLICIES["v2"])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked documents."""
    return jaccard.first_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat anywhere."""
    return substring.cleaned(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in training sequences."""
    return packing.packed(docs, VOCABULARY)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("packing", sequences),
]

#: No SQL: a learned score decides which documents reach the later stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage stored on its way is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *stages, (_, last) = STAGES
    for name, stage in stages:
        path = new_folder(spark, name)
        with scratch(spark) as noted:
            docs = cut(stage(spark, docs, sf_dir), path)
        noted.release()
    return last(spark, docs, sf_dir)

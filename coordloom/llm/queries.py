"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coordloom.llm import (
    ann, bpe, chat, hard_negatives, html_text, jaccard, mixing, packing, quality_rules, rule_ensemble,
    substring, url_filter, variants,
)
from coordloom.session import cut

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of every document."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(documents, VOCABULARY).drop("text")


def op2_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20, among all."""
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing.packed(_table(spark, sf_dir, "documents"), VOCABULARY)


#: The rules of the registered query: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest fitting rule and the verdict for the url of every page."""
    rules = spark.createDataFrame(pa.table(
        dict(zip(("host", "path", "verdict"), map(list, zip(*URL_RULES))))))
    return url_filter.judge(_table(spark, sf_dir, "pages"), rules)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and verdicts of every document."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.verdicts(documents).drop("text")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what the examples made from every conversation hold."""
    tricky = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.examples(turns.unionByName(tricky)))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extracted(pages)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the shingle set and component of every document."""
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by rules learned outside the held-out fold."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = rule_ensemble.fit(rule_ensemble.training_rows(
        documents, _table(spark, sf_dir, "labels")))
    return rule_ensemble.scored(documents, model).select(
        "doc_id", rule_ensemble.in_fold(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= rule_ensemble.KEEP_FROM).cast("int").alias("predicted"))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from every document as part of a repeated passage."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.without_repeats(documents).select(
        "doc_id", "n_words", "n_removed",
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hard negatives of every positive of every vector whose id is divisible by 50."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    counted = cut(_table(spark, sf_dir, "documents").select(
        "doc_id", "source", mixing.words_in(F.col("text")).alias("size")))
    return mixing.mixed(counted, size=F.col("size")).select("doc_id", "size", "source_size", "target", "taken")


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of all documents with the word that it is taken for a variant of."""
    return variants.grouped(_table(spark, sf_dir, "documents"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_learned_partitions": op2_learned_partitions,
    "op3_packing": op3_packing,
    "op4_url_filter": op4_url_filter,
    "op5_quality_rules": op5_quality_rules,
    "op6_chat": op6_chat,
    "op7_html_text": op7_html_text,
    "op8_jaccard": op8_jaccard,
    "op9_rule_ensemble": op9_rule_ensemble,
    "op10_substring": op10_substring,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_mixing": op12_mixing,
    "op13_variants": op13_variants,
}

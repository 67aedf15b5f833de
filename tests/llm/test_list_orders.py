"""What near duplicates count and move: frequent shingles at any size, narrow rows."""

from __future__ import annotations

import random

import numpy as np
from conftest_llm import prose

from coordloom.llm import jaccard
from coordloom.llm.counters import FREQUENT_CELLS, bits_for, cell_of, frequent, slot_column, tallied


def test_frequent_keys_stand_out_among_many(spark):
    """Twenty texts share a key; so many others are there that counters of a fixed number fill up."""
    rng = np.random.default_rng(5)
    shared = rng.integers(0, 1 << 64, 40, np.uint64)
    many = 60_000

    def keys_of(column):
        for k in column.to_pylist():
            own = np.random.default_rng(k + 100).integers(0, 1 << 64, many, np.uint64)
            yield np.append(own, shared if k < 20 else shared[:0])

    df = spark.range(60, numPartitions=5)
    table = frequent(df, "id", keys_of, 60 * many, 17)
    assert (table[cell_of(shared, FREQUENT_CELLS)] >= 20).all() and (table > 0).sum() <= 45


def test_tallies_equal_plain_counts(spark):
    rng = np.random.default_rng(6)
    rows = [rng.choice(np.arange(1, 400, dtype=np.int64) * 0x9E3779B97F4A7C1, 30).tolist() for _ in range(200)]
    df = spark.createDataFrame([(r,) for r in rows], "tokens array<long>").repartition(6)
    bits = bits_for(64 * 6000)
    got = {r.slot: r.n for r in tallied(
        df, "tokens", lambda column: [column.flatten().to_numpy()], bits, 6000, 2).collect()}
    slots, n = np.unique(cell_of(np.concatenate(rows).view(np.uint64), 1 << bits), return_counts=True)
    assert got == {s: k for s, k in zip(slots.tolist(), n.tolist()) if k > 1}
    told = df.selectExpr("explode(tokens) AS token").select(slot_column("token", bits).alias("s")).distinct()
    assert {r.s for r in told.collect()} == set(slots.tolist())


def test_sets_are_stored_once(spark, monkeypatch):
    """Prefixes are written in one table, and whole sets in none: texts stand for them."""
    rng = random.Random(4)
    texts = [prose(80, rng, 10 ** 6) for _ in range(60)]
    texts += [f"{t} {k}" for k in range(3) for t in texts[:30]] + texts[30:40]
    stored, write = [], jaccard.cut

    def noted(df, *path):
        stored.append(dict(df.dtypes))
        return write(df, *path)

    monkeypatch.setattr(jaccard, "cut", noted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in jaccard.near_duplicates(df).collect()}
    assert all(found[60 + 30 * k + j] == j for k in range(3) for j in range(30))
    assert all(found[150 + k] == 30 + k for k in range(10)) and len(set(found.values())) == 60
    assert [t["tokens"] for t in stored if "tokens" in t] == ["array<bigint>"]


def test_a_stage_moves_no_sets(spark, monkeypatch):
    """The pipeline's stage stores one table of prefixes and no whole sets."""
    import corpus_pipeline

    rng = random.Random(9)
    texts = [prose(60, rng, 10 ** 6) for _ in range(40)]
    rows = list(enumerate(texts + [f"{t} more" for t in texts[:20]] + texts[:5]))
    stored, write = [], jaccard.cut

    def noted(df, *path):
        stored.append(dict(df.dtypes))
        return write(df, *path)

    monkeypatch.setattr(jaccard, "cut", noted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, df, "").collect()
    assert sorted(map(tuple, kept)) == rows[:40]
    assert sum("tokens" in t for t in stored) == 1

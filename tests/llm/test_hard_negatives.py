"""Hard negatives against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from coordloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, is_anchor, positives=5, negatives=3, low=50, high=95) -> list[tuple]:
    kept = set()
    for k, v, label in rows:
        if k is not None and label is not None and v is not None and all(
                x is not None and math.isfinite(x) for x in v):
            kept.add((k, tuple(math.floor(256 * x) for x in v), label))
    out = []
    for k, v, label in kept:
        if not is_anchor(k):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, m) for j, w, m in kept if len(w) == len(v)]
        same = sorted((s, j) for s, j, m in scored if m == label and j != k)[:positives]
        other = sorted((s, j) for s, j, m in scored if m != label)
        for s, j in same:
            fit = [(t, i) for t, i in other if low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(k, j, r, i, -s, -t) for r, (t, i) in enumerate(fit, 1)]
    return sorted(out)


def got_of(spark, rows, every=3, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, hn.mined(df, F.col("vec_id") % every == 0, **more).collect()))


def table(seed, n, dim=6, labels=4, coarse=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) + 0.4
    if coarse:
        x = np.round(x) / 16
    return [(k, x[k].tolist(), int(rng.integers(labels))) for k in range(n)]


@pytest.mark.parametrize("seed, coarse", [(1, False), (2, True), (3, True)])
def test_equals_brute_force_over_many_cells(spark, monkeypatch, seed, coarse):
    monkeypatch.setattr(hn, "ANCHOR_NUMBERS", 200)
    monkeypatch.setattr(hn, "BLOCK_ROWS", 60)
    rows = table(seed, 220, coarse=coarse)
    want = plain(rows, lambda k: k % 3 == 0)
    assert len(want) > 100 and got_of(spark, rows) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = table(4, 40, 2, 2, True) + [
        (100, None, 1), (101, [1.0, None], 1), (102, [nan, 1.0], 0), (103, [inf, 1.0], 0), (104, [1.0, 1.0], None),
        (None, [1.0, 1.0], 1), (105, [0.0, 0.0], 1), (106, [], 1), (109, [], 0), (107, [1.0, 2.0, 3.0], 0),
        (108, [2.0, 2.0, 3.0], 0), (111, [1.0, 1.0, 3.0], 1), (105, [0.0, 0.0], 1)]
    rows += rows[:5]  # repeated rows are one
    rows += [(3, [0.5, 0.25], 1), (3, [0.5, -0.25], 0)]  # one key, several rows
    want = plain(rows, lambda k: k % 3 == 0)
    assert got_of(spark, rows) == want


def test_empty_table_and_few_candidates(spark):
    assert got_of(spark, []) == []
    assert got_of(spark, [(0, [1.0], 1)]) == []
    rows = [(0, [1.0], 1), (1, [1.0], 1), (2, [0.75], 2)]
    assert got_of(spark, rows) == [(0, 1, 1, 2, 65536, 49152)]


def test_a_third_of_all_rows_has_one_vector(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_ROWS", 50)
    rows = [(k, [0.5, 0.5, 0.25] if k % 3 == 1 else v, m) for k, v, m in table(5, 200, 3, 3)]
    assert got_of(spark, rows, 10) == plain(rows, lambda k: k % 10 == 0)


def test_keys_sort_by_anchor_falling_score_and_id():
    rng = random.Random(1)
    rows = [(rng.randint(-3, 3), rng.randint(-2, 2), rng.randint(-9, 9), rng.randint(-5, 5)) for _ in range(300)]
    kinds = [rng.randint(0, 1) for _ in rows]
    keys = [hn.packed_keys(*(np.array([x]) for x in (a, m, s)), kind, np.array([i]))[0].as_py()
            for (a, m, s, i), kind in zip(rows, kinds)]
    assert [hn.unpacked(k) for k in keys] == [(a, m, s, kind, i) for (a, m, s, i), kind in zip(rows, kinds)]
    assert [hn.unpacked(k) for k in sorted(keys)] == sorted(
        map(hn.unpacked, keys), key=lambda t: (t[0], t[1], -t[2], t[3], t[4]))


def test_scores_are_exact_or_refused():
    big = np.array([[(1 << 29) + 1, 3]], np.int64)
    assert hn._scores(big, big)[0, 0] == ((1 << 29) + 1) ** 2 + 9
    with pytest.raises(ValueError):
        hn._scores(np.array([[1 << 40]], np.int64), np.array([[1 << 40]], np.int64))


def test_clashing_columns_and_own_label(spark):
    rows = table(6, 60, 3, 3)
    df = spark.createDataFrame(rows, SCHEMA).select(
        "*", F.lit(1).alias("id"), F.lit(2).alias("q"), F.lit("x").alias("mark"), F.lit(4).alias("a.b"))
    got = sorted(map(tuple, hn.mined(df, F.col("vec_id") % 5 == 0, label=F.col("label") % 2).collect()))
    assert got == plain([(k, v, m % 2) for k, v, m in rows], lambda k: k % 5 == 0)


def test_bad_arguments(spark):
    df = spark.createDataFrame([], SCHEMA)
    for bad in ({"low": 96}, {"high": 101}, {"positives": 0}):
        with pytest.raises(ValueError):
            hn.mined(df, F.lit(True), **bad)

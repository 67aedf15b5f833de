"""Sums that do not depend on the order of the rows, against exact arithmetic."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from coordloom.functions import exact_sums
from coordloom.operators import marginal, matmul, norm, reshape, sum_axis
from coordloom.sources import from_rows, to_coo


def rounded(xs) -> float:
    return float(sum(map(Fraction, xs)))


def sums_of(spark, groups: dict) -> dict:
    rows = [(k, x) for k, xs in groups.items() for x in xs]
    random.Random(4).shuffle(rows)
    df = spark.createDataFrame(rows, "k int, x double").repartition(5)
    return {r.k: r.x for r in exact_sums(df, ["k"], ["x"]).collect()}


def test_sums_are_rounded_once(spark):
    rng = random.Random(2)
    groups = {
        0: [0.1] * 1000,
        1: [rng.gauss(0, 1) * 10.0 ** rng.randint(-30, 30) for _ in range(800)],
        2: [1e300, 1.0, -1e300, 1e-300],
        3: [rng.uniform(-1, 1) for _ in range(500)],
        4: [2.0 ** 53, 1.0, 2.0 ** -40], 5: [2.0 ** 53, 1.0], 6: [2.0 ** 53, 1.0, -(2.0 ** -60)],
        7: [-x for x in (2.0 ** 53, 1.0, 2.0 ** -40)],
        8: [0.0, -0.0], 9: [1.5, -1.5], 10: [5e-324, 5e-324, 1e-310], 11: [-2.0 ** -1000, 2.0 ** -1001, 1e-320],
        12: [1.7e308, 1e292, -1.6e308], 13: [2.0 ** (24 * k) for k in range(-30, 30)],
        14: [math.nextafter(2.0 ** (24 * k), 0) * s for k in range(-30, 30) for s in (1, -1, 1)],
        15: [-1e-5, -3e22, 7.0], 16: [rng.random() * 2.0 ** -950 for _ in range(50)],
    }
    got = sums_of(spark, groups)
    assert {k: got[k] for k in groups} == {k: rounded(xs) for k, xs in groups.items()}


def test_nulls_and_numbers_that_are_not_finite(spark):
    nan, inf = math.nan, math.inf
    got = sums_of(spark, {0: [None, 1.0], 1: [None], 2: [inf, 1.0], 3: [inf, -inf], 4: [nan, 2.0], 5: [-inf, 1e300]})
    assert got[0] == 1.0 and got[1] is None and got[2] == inf and got[5] == -inf
    assert math.isnan(got[3]) and math.isnan(got[4])
    empty = spark.createDataFrame([], "k int, x double, y double")
    assert exact_sums(empty, ["k"], ["x", "y"]).collect() == []


def test_several_values(spark):
    df = spark.createDataFrame([(1, 0.1, None), (1, 0.2, 3.0), (2, None, None)], "k int, x double, y double")
    assert sorted(map(tuple, exact_sums(df, ["k"], ["x", "y"]).collect())) == [(1, rounded([0.1, 0.2]), 3.0),
                                                                              (2, None, None)]


@pytest.fixture(scope="module")
def irrational(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(size=2400) * np.exp(rng.normal(size=2400) * 8)
    return values, spark.createDataFrame([(k, float(x)) for k, x in enumerate(values)], "k long, x double").cache()


def test_norm_and_sums_over_any_partitions(spark, irrational):
    values, df = irrational
    want_norm = math.sqrt(rounded(values * values))
    want = values.reshape(4, 6, 100)
    seen = []
    for parts in (1, 7, 211):
        v = to_coo(df.repartition(parts), "k", df.k * 0, "x", dims=(2400, 1), key=True)
        assert norm(v, exact=True).first()[0] == want_norm
        t = reshape(v, (4, 6, 100))
        got = {r.i2: r.val for r in sum_axis(t, [1, 3], exact=True).df.collect()}
        assert got == {k: rounded(want[:, k].ravel()) for k in range(6)}
        seen.append(sorted(map(tuple, marginal(v, (4, 6, 100), [1], exact=True).df.collect())))
        assert sum_axis(t, [1, 2, 3], exact=True).df.first()[0] == rounded(values)
    assert seen[0] == seen[1] == seen[2]
    assert norm(to_coo(df.limit(0), "k", "k", "x", dims=(1, 1)), exact=True).first()[0] == 0.0


def test_exact_product(spark):
    a = from_rows(spark, [(0, k, x) for k, x in enumerate([1e16, 1.0, -1e16, 0.5])], (1, 4))
    b = from_rows(spark, [(k, 0, 1.0) for k in range(4)], (4, 1))
    assert [tuple(r) for r in matmul(a, b, exact=True).df.collect()] == [(0, 0, 1.5)]
    c = from_rows(spark, [(k, 0, 0.0, 1.0) for k in range(4)], (4, 1))
    assert [tuple(r) for r in matmul(a, c, exact=True).entries().collect()] == [(0, 0, 0.0, 1.5)]

from __future__ import annotations

import numpy as np
import pytest

from conftest import THRESHOLD, dense, random_sparse, sparse
from coordloom.operators import densify, iterate_reflect, reflect
from coordloom.sources import from_rows, uniform_vector
from coordloom.table import CooTable


def reflected(x: np.ndarray, flipped: set[int], steps: int = 1) -> np.ndarray:
    """By the full matrix ``(2/N - I) . S``."""
    n = len(x)
    sign = np.array([-1.0 if i in flipped else 1.0 for i in range(n)])
    matrix = (np.full((n, n), 2 / n) - np.eye(n)) * sign
    return np.linalg.matrix_power(matrix, steps) @ x


def marks(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "row long")


@pytest.mark.parametrize("flipped", [[], [0], [1, 5, 6, 6]])
@pytest.mark.parametrize("steps", [1, 2, 5])
def test_against_the_full_matrix(spark, rng, flipped, steps):
    x = random_sparse(rng, (9, 1), 0.5)
    got = iterate_reflect(sparse(spark, x), steps, marks(spark, flipped))
    assert got.count() == 9
    assert np.allclose(dense(got), reflected(x, set(flipped), steps), atol=1e-12)


def test_repeats_and_large_vectors(spark, no_broadcast):
    v = from_rows(spark, [(1, 0, 2), (1, 0, 3), (6, 0, 1)], (8, 1))
    x = np.array([[0, 5, 0, 0, 0, 0, 1, 0]], dtype=float).T
    assert np.allclose(dense(reflect(v, marks(spark, [4]))), reflected(x, {4}), atol=1e-12)


def test_twice_without_flips_is_the_identity(spark, rng):
    x = random_sparse(rng, (16, 1), 0.5)
    assert np.array_equal(dense(reflect(reflect(sparse(spark, x)))), x)


def test_many_steps_stay_one_plan(spark):
    n, steps = 1 << 12, 142
    v = uniform_vector(spark, n)
    got = iterate_reflect(v, steps, marks(spark, [7]))
    angle = np.arcsin(1 / np.sqrt(n))
    top = got.df.where("row = 7").first()["re"]
    assert abs(top) == pytest.approx(abs(np.sin((2 * steps + 1) * angle)), abs=1e-9)


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_an_index_outside_raises_whatever_the_join(spark, threshold):
    before = spark.conf.get(THRESHOLD)
    spark.conf.set(THRESHOLD, threshold)
    try:
        outside = spark.createDataFrame([(1, 0, 1.0), (9, 0, 2.0)], "row long, col long, re double")
        with pytest.raises(Exception, match="outside"):
            densify(CooTable(outside, (4, 1), unique=True)).df.collect()
        with pytest.raises(Exception, match="outside"):
            reflect(uniform_vector(spark, 4), marks(spark, [4])).df.collect()
    finally:
        spark.conf.set(THRESHOLD, before)


def test_wrong_arguments(spark):
    v = uniform_vector(spark, 8)
    for call in (lambda: iterate_reflect(v, 0), lambda: reflect(from_rows(spark, [], (4, 2)))):
        with pytest.raises(ValueError):
            call()

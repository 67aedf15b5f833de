from __future__ import annotations

import itertools

import numpy as np
import pytest

from conftest import dense, random_sparse, sparse
from coordloom.operators import (
    abs_square, marginal, norm, ravel, renamed, reshape, sum_axis,
)
from coordloom.sources import from_rows, read_parquet, write_parquet

SHAPE = (2, 3, 2, 4)


@pytest.fixture
def vector(rng):
    return random_sparse(rng, (48, 1), 0.6, complex_values=False)


def array(t) -> np.ndarray:
    out = np.zeros(t.dims)
    for r in t.df.collect():
        out[tuple(r[a] for a in t.axes)] += r["val"]
    return out


def test_reshape_and_back(spark, vector):
    v = sparse(spark, vector)
    t = reshape(v, SHAPE)
    assert (t.dims, t.axes, t.values) == (SHAPE, ("i1", "i2", "i3", "i4"), ("val",))
    assert np.array_equal(array(t), vector.real.reshape(SHAPE))
    assert np.array_equal(dense(ravel(t)), vector)


def test_reshape_keeps_complex_values(spark, rng):
    v = random_sparse(rng, (6, 1), 1.0)
    t = reshape(sparse(spark, v), (2, 3))
    assert t.values == ("re", "im")
    assert np.array_equal(dense(ravel(t)), v)
    with pytest.raises(ValueError):
        sum_axis(t, [1])


def test_sum_axis_every_choice(spark, vector):
    t, want = reshape(sparse(spark, vector), SHAPE), vector.real.reshape(SHAPE)
    for k in (1, 2, 3, 4):
        for axes in itertools.combinations((1, 2, 3, 4), k):
            got = sum_axis(t, axes[::-1])
            total = want.sum(axis=tuple(a - 1 for a in axes))
            assert got.dims == total.shape
            assert np.array_equal(array(got), total)


def test_axis_by_axis_equals_at_once(spark, vector):
    t = reshape(sparse(spark, vector), SHAPE)
    stepwise = sum_axis(sum_axis(t, [3]), [1])
    assert np.array_equal(array(stepwise), array(sum_axis(t, [1, 3])))
    assert stepwise.axes == ("i2", "i4")
    assert renamed(stepwise).axes == ("i1", "i2")
    assert np.array_equal(array(renamed(stepwise)), array(stepwise))


def test_position_anywhere(spark, vector):
    """Fixed axes to the left, between and to the right of summed ones."""
    t, want = reshape(sparse(spark, vector), SHAPE), vector.real.reshape(SHAPE)
    cases = [
        ([1], ("?", "?", 1, 2), want[:, :, 1, 2].sum(axis=0)),
        ([4], (1, 2, "?", "?"), want[1, 2].sum(axis=1)),
        ([3], (1, "?", "?", "?"), want[1].sum(axis=1)),
        ([2], ("?", "?", 0, None), want[:, :, 0].sum(axis=1)),
        ([1, 2], ("?", 1, "?", 3), want[:, 1, :, 3].sum(axis=0)),
        ([], (1, 1, 1, 1), want[1, 1, 1, 1]),
    ]
    for axes, position, total in cases:
        got = sum_axis(t, axes, position)
        assert got.dims == total.shape
        assert np.array_equal(array(got), total)


def test_leading_position_reaches_the_scan(spark, vector, tmp_path):
    write_parquet(sparse(spark, vector), str(tmp_path / "v"))
    t = reshape(read_parquet(spark, str(tmp_path / "v")), SHAPE)
    df = sum_axis(t, [4], (1, 2, "?", "?")).df
    scan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(row,40)" in scan and "LessThan(row,48)" in scan


def test_zero_sums_are_kept(spark):
    v = from_rows(spark, [(0, 0, 1), (2, 0, -1)], (4, 1))
    assert [tuple(r) for r in sum_axis(reshape(v, (2, 2)), [1]).df.collect()] == [(0, 0.0)]


def test_all_axes_leave_one_row(spark):
    v = from_rows(spark, [(0, 0, 1), (3, 0, 4)], (4, 1))
    assert [tuple(r) for r in sum_axis(reshape(v, (2, 2)), [1, 2]).df.collect()] == [(5.0,)]
    empty = from_rows(spark, [], (4, 1))
    assert [tuple(r) for r in sum_axis(reshape(empty, (2, 2)), [1, 2]).df.collect()] == [(0.0,)]
    total = ravel(sum_axis(reshape(v, (2, 2)), [1, 2]))
    assert total.dims == (1, 1) and dense(total)[0, 0] == 5


def test_axis_ten(spark, rng):
    shape = (2,) * 10
    v = random_sparse(rng, (1024, 1), 0.2, complex_values=False)
    got = sum_axis(reshape(sparse(spark, v), shape), [10, 1])
    assert np.array_equal(array(got), v.real.reshape(shape).sum(axis=(0, 9)))


def test_wrong_arguments(spark, vector):
    v = sparse(spark, vector)
    t = reshape(v, SHAPE)
    with pytest.raises(ValueError):
        reshape(v, (2, 3))
    with pytest.raises(ValueError):
        reshape(v, (1 << 32, 1 << 32))
    for axes in ([0], [5], [-1]):
        with pytest.raises(ValueError):
            sum_axis(t, axes)
    with pytest.raises(ValueError):
        sum_axis(t, [1], ("?", 1))
    with pytest.raises(ValueError):
        marginal(v, SHAPE, [5])


def test_marginal_with_any_measured_axes(spark, rng):
    v = random_sparse(rng, (48, 1), 0.6)
    want = (np.abs(v) ** 2).round().reshape(SHAPE)
    state = sparse(spark, v)
    assert np.array_equal(array(marginal(state, SHAPE, [1])), want.sum(axis=(1, 2, 3)))
    assert np.array_equal(array(marginal(state, SHAPE, [2, 4])), want.sum(axis=(0, 2)))
    at = marginal(state, SHAPE, [1, 2], ("?", "?", 1, 3))
    assert np.array_equal(array(at), want[:, :, 1, 3])


def test_marginal_of_axis_ten_is_not_axis_one(spark, rng):
    shape = (2,) * 10
    v = random_sparse(rng, (1024, 1), 0.2)
    want = (np.abs(v) ** 2).round().reshape(shape)
    got = marginal(sparse(spark, v), shape, [10])
    assert np.array_equal(array(got), want.sum(axis=tuple(range(9))))


def test_norm_and_squared_magnitude(spark, rng):
    a = random_sparse(rng, (5, 4))
    t = sparse(spark, a)
    assert norm(t).first()["norm"] == pytest.approx(np.linalg.norm(a), abs=1e-12)
    squared = abs_square(t)
    assert not squared.is_complex and squared.dims == t.dims
    assert np.array_equal(dense(squared).real, a.real ** 2 + a.imag ** 2)

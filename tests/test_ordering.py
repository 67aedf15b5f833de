"""Orders of products by estimated cost, and Kronecker forms found in tables."""

from __future__ import annotations

import math

import numpy as np
import pytest
from conftest import dense, random_sparse, sparse

from coordloom.operators import AxisOperator, apply_on_axis, axis_form, kron, kron_factors, matmul
from coordloom.plans import ordering
from coordloom.plans import chain_apply, cheapest_order, compose, estimated_entries, simplified
from coordloom.sources import from_rows, identity
from coordloom.table import CooTable


def skewed(rng, rows, cols, entries):
    a = np.zeros((rows, cols))
    a[rng.zipf(1.6, entries) % rows, rng.integers(0, cols, entries)] = 1
    return a


SHAPES = {
    "uniform": lambda rng: [random_sparse(rng, (60, 80), 0.05, False), random_sparse(rng, (80, 70), 0.05, False)],
    "skewed": lambda rng: [skewed(rng, 200, 100, 300), skewed(rng, 200, 100, 300).T[:100]],
    "blocks": lambda rng: [np.kron(np.eye(12), np.ones((5, 5)))] * 3,
    "dense": lambda rng: [np.ones((40, 3)), np.ones((3, 90))],
    "long": lambda rng: [random_sparse(rng, (50, 50), 0.03, False) for _ in range(4)],
}


@pytest.mark.parametrize("shape", list(SHAPES))
def test_estimates_within_a_factor_of_two(spark, rng, shape):
    arrays = [(a != 0).astype(float) for a in SHAPES[shape](rng)]
    got = estimated_entries([sparse(spark, a) for a in arrays])
    for i in range(len(arrays)):
        product = arrays[i]
        for j in range(i, len(arrays)):
            product = product if i == j else product @ arrays[j]
            true = np.count_nonzero(product)
            assert true / 2 <= got.get((i, j), 0.0) <= 2 * true or true == got.get((i, j), 0) == 0, (i, j)


def test_tall_wide_vector_goes_right_to_left(spark, rng):
    tall, wide, v = (random_sparse(rng, s, 0.3, False) for s in ((40, 5), (5, 40), (40, 1)))
    ops = [sparse(spark, x) for x in (tall, wide, v)]
    assert cheapest_order(ops) == (0, (1, 2))
    assert cheapest_order(ops, small=0) == (0, (1, 2))
    assert np.array_equal(dense(compose(ops)), tall @ wide @ v)


def test_sparsity_decides_where_shapes_do_not(spark, rng):
    """Three square operators: the empty-ish one should be met first."""
    n = 60
    full, thin = np.ones((n, n)), np.zeros((n, n))
    thin[3, 7] = thin[9, 1] = 2
    one_row = np.zeros((n, n))
    one_row[7, :] = 1
    for arrays, order in (([full, full, thin], (0, (1, 2))), ([thin, full, full], ((0, 1), 2)),
                          ([full, thin, full, one_row], None)):
        ops = [sparse(spark, a) for a in arrays]
        got = cheapest_order(ops, small=0)
        assert order is None or got == order
        want = np.linalg.multi_dot(arrays)
        assert np.array_equal(dense(compose(ops)), want)
        assert np.array_equal(dense(compose(ops, order=got)), want)


def test_orders_given_by_hand(spark, rng):
    arrays = [random_sparse(rng, (6, 6)) for _ in range(4)]
    ops = [sparse(spark, a) for a in arrays]
    want = np.linalg.multi_dot(arrays)
    for order in ("left", "auto", ((0, 1), (2, 3)), (0, ((1, 2), 3))):
        assert np.array_equal(dense(compose(ops, order=order)), want)
    for wrong in ((0, (1, 2)), ((1, 0), (2, 3)), 0):
        with pytest.raises(ValueError):
            compose(ops, order=wrong)
    with pytest.raises(ValueError):
        compose([ops[0], sparse(spark, np.ones((5, 2)))])


def shipped_form(spark, left: int, size: int, right: int):
    """A walk's step: a coin of two sides, then a shift to either side, 4 * size entries."""
    r = math.sqrt(0.5)
    shift = np.zeros((2 * size, 2 * size))
    for side in (0, 1):
        for x in range(size):
            shift[side * size + x, side * size + (x + (-1) ** side) % size] = 1
    w = shift @ np.kron(np.array([[r, r], [r, -r]]), np.eye(size))
    return w, sparse(spark, np.kron(np.kron(np.eye(left), w), np.eye(right)))


@pytest.mark.parametrize("left, right", [(1, 100), (100, 1), (10, 10), (4, 6)])
def test_axis_form_is_found(spark, left, right):
    w, t = shipped_form(spark, left, 5, right)
    found = axis_form(t)
    assert isinstance(found, AxisOperator) and found.sizes == (left, 10, right)
    assert found.matrix.count() == 20 and found.dims == t.dims
    assert np.array_equal(dense(found.matrix), w)
    v = from_rows(spark, [(k, 0, k + 1) for k in range(0, t.dims[1], 7)], (t.dims[1], 1))
    assert np.allclose(dense(apply_on_axis(found.matrix, v, found.sizes, 2)), dense(matmul(t, v)))


def test_axis_form_of_rectangles_and_complex_values(spark, rng):
    w = random_sparse(rng, (3, 4), 0.9)
    w[0, 3], w[2, 0] = 5 + 2j, 1j
    t = kron(kron(identity(spark, 5), sparse(spark, w)), identity(spark, 2))
    found = axis_form(t)
    assert found.sizes == (5, 4, 2) and np.array_equal(dense(found.matrix), w)


def test_tables_without_the_form(spark, rng):
    w, t = shipped_form(spark, 2, 3, 2)
    entries = t.df.collect()
    for change in (lambda r: r[2] + 1e-9, None):
        rows = [tuple(r) for r in entries]
        rows = rows[1:] if change is None else [(*rows[0][:2], change(rows[0])), *rows[1:]]
        assert axis_form(from_rows(spark, rows, t.dims)) is None
    assert axis_form(sparse(spark, random_sparse(rng, (7, 7), 0.8))) is None
    assert axis_form(from_rows(spark, [], (6, 6))) is None
    assert axis_form(from_rows(spark, [(0, 1, 1), (1, 0, 1)], (2, 2))) is None
    whole = axis_form(identity(spark, 12))
    assert whole.sizes == (12, 1, 1) and whole.matrix.count() == 1


def test_chain_of_simplified_operators(spark):
    _, t = shipped_form(spark, 3, 3, 2)
    other = from_rows(spark, [(k, (k * 5 + 1) % 36, 1 + k % 3) for k in range(36)], (36, 36))
    v = from_rows(spark, [(k, 0, k + 1) for k in range(36)], (36, 1))
    ops = simplified([t, other, t])
    assert isinstance(ops[0], AxisOperator) and ops[0] is ops[2] and ops[1] is other
    assert np.allclose(dense(chain_apply(ops, v, 2).state), dense(chain_apply([t, other, t], v, 2).state))


@pytest.mark.parametrize("complex_values", [True, False])
def test_kron_factors(spark, rng, complex_values):
    a, b = (random_sparse(rng, s, 0.7, complex_values) for s in ((2, 3), (4, 2)))
    a[1, 2], b[0, 1] = 3, 2
    t = kron(sparse(spark, a), sparse(spark, b))
    left, right = kron_factors(t, (2, 3))
    assert np.allclose(dense(kron(left, right)), np.kron(a, b))
    rows = [tuple(r) for r in t.entries().collect()]
    assert kron_factors(from_rows(spark, rows[1:], t.dims), (2, 3)) is None
    assert kron_factors(from_rows(spark, [(*rows[0][:2], rows[0][2] + 1, rows[0][3]), *rows[1:]], t.dims),
                        (2, 3)) is None
    assert kron_factors(CooTable(t.df.limit(0), t.dims), (2, 3)) is None
    with pytest.raises(ValueError):
        kron_factors(t, (3, 3))


def test_sketches_are_packed_and_only_met_sides_are_sketched(spark, rng, monkeypatch):
    """Minima move as four words, and the outer sides of a chain, which no product meets, not at all."""
    arrays = [random_sparse(rng, s, 0.3, False) for s in ((30, 20), (20, 25), (25, 9))]
    ops = [sparse(spark, a).store() for a in arrays]
    kept = ordering._carried(ops[1], "row", "col", 1, ordering._carried(ops[2], "row", "col", 2, None, 32), 32)
    assert sum(c.startswith("m") for c in kept.columns) == 4
    rows, columns = ordering.estimates(ops, inner=True)
    assert {tuple(r) for r in rows.select("first", "last").distinct().collect()} == {(1, 1), (1, 2), (2, 2)}
    assert {tuple(r) for r in columns.select("first", "last").distinct().collect()} == {(0, 0), (0, 1), (1, 1)}
    whole = ordering.estimates(ops)
    for some, every in zip((rows, columns), whole):
        assert set(map(tuple, some.collect())) <= set(map(tuple, every.collect()))
    # Indices of many rows are cut into cells, with the same minima.
    monkeypatch.setattr(ordering, "HOT_ENTRIES", 2)
    monkeypatch.setattr(ordering, "TASK_ENTRIES", 7)
    for cut, every in zip(ordering.estimates(ops), whole):
        assert set(map(tuple, cut.collect())) == set(map(tuple, every.collect()))

from __future__ import annotations

import math

import numpy as np
import pytest

from conftest import dense, random_sparse, sparse
from coordloom.functions import COMPONENTWISE
from coordloom.operators import (
    AxisOperator, apply_on_axis, joins, kron, matmul, norm, prune_zeros, self_product,
)
from coordloom.operators.joins import cells_join, hot_keys
from coordloom.sources import from_rows, identity, store_bucketed
from coordloom.table import CooTable


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_complex_and_componentwise_differ(spark):
    a = np.array([[1 + 2j, 3 - 1j], [0, 2j]])
    b = np.array([[2 - 1j, 1], [1 + 1j, -3j]])
    x, y = sparse(spark, a), sparse(spark, b)
    assert np.array_equal(dense(matmul(x, y)), a @ b)
    parts = a.real @ b.real + 1j * (a.imag @ b.imag)
    assert np.array_equal(dense(matmul(x, y, COMPONENTWISE)), parts)
    assert not np.array_equal(parts, a @ b)


@pytest.mark.parametrize("left_complex", [True, False])
@pytest.mark.parametrize("right_complex", [True, False])
def test_mixed_real_and_complex(spark, rng, left_complex, right_complex):
    a = random_sparse(rng, (5, 4), complex_values=left_complex)
    b = random_sparse(rng, (4, 6), complex_values=right_complex)
    x, y = sparse(spark, a), sparse(spark, b)
    got = matmul(x, y)
    assert got.is_complex == (left_complex or right_complex)
    assert np.array_equal(dense(got), a @ b)
    assert np.array_equal(dense(kron(x, y)), np.kron(a, b))
    parts = np.kron(a.real, b.real) + 1j * np.kron(a.imag, b.imag)
    assert np.array_equal(dense(kron(x, y, COMPONENTWISE)), parts)


def test_cancelled_entry_is_dropped_by_matmul_and_kept_by_kron(spark):
    a = from_rows(spark, [(0, 0, 1), (0, 1, 1)], (1, 2))
    b = from_rows(spark, [(0, 0, 2), (1, 0, -2)], (2, 1))
    assert matmul(a, b).count() == 0
    zero = from_rows(spark, [(0, 0, 0)], (1, 1))
    assert kron(zero, a).count() == 2


def test_repeated_coordinates_add_up(spark):
    a = from_rows(spark, [(0, 0, 1), (0, 0, 2)], (1, 1))
    b = from_rows(spark, [(0, 0, 5), (0, 0, 7)], (1, 1))
    assert not a.unique and a.bound == 2
    assert dense(matmul(a, b))[0, 0] == 36
    assert matmul(a, b).count() == 1
    assert kron(a, b).count() == 4


def test_empty(spark):
    a = from_rows(spark, [], (3, 2))
    b = from_rows(spark, [(0, 0, 1)], (2, 4))
    out = matmul(a, b)
    assert (out.dims, out.count()) == ((3, 4), 0)
    assert [r["norm"] for r in norm(out).collect()] == [0.0]


def test_nan_survives_pruning(spark):
    t = from_rows(spark, [(0, 0, math.nan), (0, 1, 0.0), (0, 2, 1e-9), (0, 3, 1)], (1, 4))
    assert prune_zeros(t).count() == 3
    assert prune_zeros(t, eps=1e-6).count() == 2


def test_pruning_needs_every_part_zero(spark):
    t = from_rows(spark, [(0, 0, 0, 1), (0, 1, 1, 0), (0, 2, 0, 0)], (1, 3))
    assert prune_zeros(t).count() == 2


def test_shapes_are_checked(spark):
    a = from_rows(spark, [(0, 0, 1)], (2, 3))
    with pytest.raises(ValueError):
        matmul(a, a)
    with pytest.raises(ValueError):
        matmul(a, a.transpose(), "other")
    with pytest.raises(ValueError):
        kron(a, a, "other")
    with pytest.raises(ValueError):
        AxisOperator(a, (3, 3), 3)
    with pytest.raises(ValueError):
        AxisOperator(a, (2, 2), 1)
    with pytest.raises(ValueError):
        apply_on_axis(a, from_rows(spark, [], (5, 1)), (3, 3), 1)
    with pytest.raises(ValueError):
        from_rows(spark, [(2, 0, 1)], (2, 3))
    with pytest.raises(ValueError):
        CooTable(a.df, (2, 0))
    with pytest.raises(ValueError):
        CooTable(a.df, (1 << 63, 1))


def test_algebra(spark, rng):
    a, b, c = (random_sparse(rng, s) for s in ((4, 5), (5, 3), (3, 6)))
    x, y, z = (sparse(spark, m) for m in (a, b, c))
    assert np.array_equal(dense(matmul(matmul(x, y), z)), dense(matmul(x, matmul(y, z))))
    assert np.array_equal(dense(matmul(x, identity(spark, 5))), a)
    p, q = (random_sparse(rng, s) for s in ((2, 3), (3, 2)))
    u, v = sparse(spark, p), sparse(spark, q)
    left = dense(matmul(kron(x, u), kron(y, v)))
    assert np.array_equal(left, dense(kron(matmul(x, y), matmul(u, v))))
    assert kron(x, u).dims == (8, 15)


def skewed(rng, rows, cols, n):
    """A third of all entries in column 1."""
    out = np.zeros((rows, cols))
    for i, j in zip(rng.integers(0, rows, n), rng.integers(0, cols, n)):
        out[i, j] = rng.integers(1, 9)
    out[: n // 3, 1] = rng.integers(1, 9, min(rows, n // 3))
    return out


def test_hot_keys_in_cells(spark, rng, no_broadcast):
    a = skewed(rng, 120, 12, 300)
    b = skewed(rng, 90, 12, 240).T
    x, y = sparse(spark, a), sparse(spark, b)
    got = matmul(x, y, hot=16)
    text = plan(got.df)
    assert "_cell_l" in text and "Cartesian" not in text and "NestedLoop" not in text
    assert np.array_equal(dense(got), a @ b)
    assert np.array_equal(dense(matmul(x, y, hot=None)), a @ b)
    assert np.array_equal(dense(matmul(x, y)), a @ b)


@pytest.mark.parametrize("hot, pairs", [(16, 1 << 20), (16, 40), (1000, 25), (3, 3)])
def test_no_cell_exceeds_its_bounds(spark, rng, hot, pairs):
    """More hot keys than any list once held one, of many shapes."""
    left = [(int(k), i) for i, k in enumerate(rng.zipf(1.3, 3000) % 200)]
    right = [(int(k), i) for i, k in enumerate(rng.zipf(1.5, 2000) % 200)]
    a = spark.createDataFrame(left, "k long, i long").cache()
    b = spark.createDataFrame(right, "k long, j long").cache()
    found = hot_keys(a, b, "k", hot, pairs).cache()
    sizes = {r["k"]: (r["_cells_l"], r["_cells_r"]) for r in found.collect()}
    placed_l = joins._placed(a, found, "k", ("i",), "l", "r").groupBy("k", "_cell_l", "_cell_r").count().collect()
    placed_r = joins._placed(b, found, "k", ("j",), "r", "l").groupBy("k", "_cell_l", "_cell_r").count().collect()
    n, m = ({k: sum(1 for x, _ in side if x == k) for k in range(200)} for side in (left, right))
    for k, (l, r) in sizes.items():
        per_l, per_r = -(-n[k] // l), -(-m[k] // r)
        assert per_l <= hot and per_r <= hot and per_l * per_r <= max(pairs, 1)
    for k in set(n) - set(sizes):
        assert not m[k] or not n[k] or n[k] <= hot and m[k] <= hot and n[k] * m[k] <= pairs
    for rows in (placed_l, placed_r):  # hashing deals about evenly
        assert all(x["count"] <= 8 * hot for x in rows if x["k"] in sizes)
    joined = cells_join(a, b, "k", (("i",), ("j",)), found)
    assert joined.count() == sum(n[k] * m[k] for k in n)
    assert joined.distinct().count() == joined.count()


def test_a_wide_state_of_few_rows_is_dealt_over_cells(spark, no_broadcast):
    rows = [(0, j, 1.0) for j in range(2000)]
    state = from_rows(spark, rows, (4, 2000))
    u = from_rows(spark, [(i, k, 1.0) for i in range(4) for k in range(4)], (4, 4))
    got = apply_on_axis(u, state, (1, 4), 2, hot=100)
    cells = got.df._jdf.queryExecution().analyzed().toString()
    assert "_cell_l" in cells and got.count() == 8000


@pytest.mark.parametrize("call", [
    lambda x, y: matmul(x, y, plan="cells"), lambda x, y: kron(x, y, plan="blocks"),
    lambda x, y: matmul(store_bucketed(x), y, plan="in_place")])
def test_forced_plans_do_not_broadcast_an_operand(spark, rng, call):
    a, b = random_sparse(rng, (8, 8)), random_sparse(rng, (8, 5))
    got = call(sparse(spark, a), sparse(spark, b))
    want = np.kron(a, b) if got.dims[0] == 64 else a @ b
    assert np.array_equal(dense(got), want)
    for wrong in (lambda: matmul(sparse(spark, a), sparse(spark, b), plan="in_place"),
                  lambda: matmul(sparse(spark, a), sparse(spark, b), plan="blocks")):
        with pytest.raises(ValueError):
            wrong()


def test_given_counts_never_broadcast(spark, rng):
    rows = spark.range(3000).selectExpr("id AS row", "id AS col", "1.0D AS re")
    x = CooTable(rows, (1 << 20, 1 << 20))
    got = kron(x, x, entries=(10, 10))
    assert got.at_most is None and got.bound is None
    # Spark may still broadcast by the true size; the given counts force nothing.
    assert "ResolvedHint" not in got.df._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("hot", [3, 65_536])
def test_self_product(spark, rng, hot, request):
    if hot == 3:
        request.getfixturevalue("no_broadcast")
    a = random_sparse(rng, (12, 9), complex_values=False)
    got = self_product(sparse(spark, a), hot=hot)
    assert np.array_equal(dense(got), a @ a.T) and got.count() == np.count_nonzero(a @ a.T)
    with pytest.raises(ValueError):
        self_product(sparse(spark, random_sparse(rng, (3, 3)) + 1j))


def test_hot_keys_with_repeats(spark, no_broadcast):
    rows = [(i % 40, 0, 1) for i in range(400)] + [(i, 1, 2) for i in range(40)]
    a = from_rows(spark, rows, (40, 2))
    want = dense(a) @ dense(a).T
    assert np.array_equal(dense(matmul(a, a.transpose(), hot=8)), want)


def test_shape_proves_a_merged_side_small(spark, rng):
    a, b = random_sparse(rng, (9, 4)), random_sparse(rng, (4, 3))
    x, y = (CooTable(t.df, t.dims) for t in (sparse(spark, a), sparse(spark, b)))
    assert x.bound is None and y.bound is None
    got = matmul(x, y)
    text = plan(got.df)
    assert "BroadcastHashJoin" in text and text.count("Exchange hashpartitioning") == 2
    assert np.array_equal(dense(got), a @ b)


def test_no_hot_key_no_cells(spark, rng, no_broadcast):
    a = random_sparse(rng, (6, 6))
    x = sparse(spark, a)
    assert "_cell_l" not in plan(matmul(x, x, hot=3_000).df)


def test_product_with_its_transpose_shuffles_once(spark, rng, no_broadcast):
    a = random_sparse(rng, (30, 8))
    x = sparse(spark, a)
    got = matmul(x.transpose(), x)
    got.df.collect()
    assert "ReusedExchange" in plan(got.df)
    assert np.array_equal(dense(got), a.T @ a)


def test_kron_in_blocks(spark, rng, no_broadcast):
    a, b = random_sparse(rng, (6, 5)), random_sparse(rng, (4, 7))
    x, y = sparse(spark, a), sparse(spark, b)
    got = kron(x, y, block=3)
    text = plan(got.df)
    assert "Cartesian" not in text and "NestedLoop" not in text
    assert np.array_equal(dense(got), np.kron(a, b))
    assert got.count() == x.count() * y.count()
    given = kron(x, y, entries=(x.count(), y.count()), block=3)
    assert np.array_equal(dense(given), np.kron(a, b))


def test_small_side_is_broadcast_without_a_shuffle(spark, rng):
    x = sparse(spark, random_sparse(rng, (6, 5)))
    text = plan(kron(x, sparse(spark, random_sparse(rng, (4, 7)))).df)
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


@pytest.mark.parametrize("axis", [1, 2, 3])
def test_apply_on_axis_equals_the_full_product(spark, rng, axis):
    sizes = (3, 4, 2)
    u = random_sparse(rng, (sizes[axis - 1],) * 2, 0.7)
    v = random_sparse(rng, (24, 2))
    full = np.eye(1)
    for k, s in enumerate(sizes, start=1):
        full = np.kron(full, u if k == axis else np.eye(s))
    got = apply_on_axis(sparse(spark, u), sparse(spark, v), sizes, axis)
    assert np.array_equal(dense(got), full @ v)


def test_apply_on_axis_may_change_the_size(spark, rng, no_broadcast):
    u, v = random_sparse(rng, (5, 4), 0.8), random_sparse(rng, (24, 1), 0.9)
    got = apply_on_axis(sparse(spark, u), sparse(spark, v), (3, 4, 2), 2, hot=3)
    assert got.dims == (30, 1)
    assert np.array_equal(dense(got), np.kron(np.kron(np.eye(3), u), np.eye(2)) @ v)


def test_bucketed_operator_stays_in_place(spark, rng, no_broadcast):
    a = random_sparse(rng, (40, 64), 0.5)
    v = random_sparse(rng, (64, 1), 0.9)
    op = store_bucketed(sparse(spark, a))
    assert op.bucketed == "col"
    got = matmul(op, sparse(spark, v))
    join = plan(got.df).split("SortMergeJoin")[1]
    assert join.count("Exchange hashpartitioning") == 1
    assert np.array_equal(dense(got), a @ v)
    other = random_sparse(rng, (64, 30), 0.5)
    for hot in (8, 64):  # a wide right side may hold hot keys, then nothing is in place
        assert np.array_equal(dense(matmul(op, sparse(spark, other), hot=hot)), a @ other)
    row = store_bucketed(sparse(spark, a), by="row")
    assert row.transpose().bucketed == "col"
    assert np.array_equal(dense(matmul(row.transpose(), sparse(spark, a))), a.T @ a)


def test_skewed_operator_is_not_bucketed(spark):
    rows = [(i, 0, 1) for i in range(90)] + [(i, i, 1) for i in range(1, 30)]
    op = store_bucketed(from_rows(spark, rows, (90, 30)), hot=60)
    assert op.bucketed is None and op.stored
    with pytest.raises(ValueError):
        store_bucketed(op, by="re")


def test_own_pairs_are_formed_from_lists(spark, rng, no_broadcast):
    """Columns of one list each are paired without a join; keys of long lists are joined."""
    a = np.kron(np.eye(4), random_sparse(rng, (5, 9), 0.6, False))
    t = sparse(spark, a)
    got = self_product(t)
    assert "Join" not in got.df._jdf.queryExecution().optimizedPlan().toString()
    assert np.array_equal(dense(got), a @ a.T)
    for listed, task, hot in ((1000, 7, 50), (2, 1000, 50), (3, 5, 2), (1, 1000, 1)):
        pairs = joins.own_pairs(t.df, "col", "row", "re", hot, listed, task)
        found = sorted(tuple(r) for r in pairs.select("_i", "_j", "_a", "_b").collect())
        assert found == sorted((i, j, a[i, k], a[j, k]) for k in range(a.shape[1]) for i in range(20)
                               for j in range(i, 20) if a[i, k] and a[j, k]), (listed, task, hot)


@pytest.mark.parametrize("hot", [1000, 3])
def test_tasks_of_a_join_follow_its_entries_and_pairs(spark, rng, no_broadcast, monkeypatch, hot):
    """The product of large sides is dealt over as many tasks as its pairs ask for."""
    a, b = random_sparse(rng, (40, 6), 0.8), random_sparse(rng, (6, 30), 0.8)
    monkeypatch.setattr(joins, "TASK_PAIRS", 200)
    pairs = int((np.count_nonzero(a, axis=0) * np.count_nonzero(b, axis=1)).sum())
    got = matmul(sparse(spark, a), sparse(spark, b), hot=hot, plan="cells")
    assert ("_cell_l" in plan(got.df)) == (hot == 3)
    assert plan(got.df).count(f", {-(-pairs // 200)}), REPARTITION_BY_NUM") >= 2 and -(-pairs // 200) > 8
    assert np.array_equal(dense(got), a @ b)

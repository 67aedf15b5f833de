"""Several sums from one scan, and snapshots kept as differences."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import dense, random_sparse, sparse

from coordloom.operators import marginal, marginals, reshape, sum_axis, sum_sets
from coordloom.operators.lattice import parents
from coordloom.plans import chain_apply, chain_history, changed
from coordloom.session import scratch
from coordloom.sources import from_rows, read_parquet, write_parquet

SETS = [[2, 4], [1], [2], [4], [1, 2], []]


def test_each_set_has_the_smallest_parent():
    got = parents([frozenset(s) for s in SETS], (50, 2, 30, 3))
    root = frozenset({1, 2, 4})
    assert got == {root: None, frozenset({1, 2}): root, frozenset({2, 4}): root, frozenset({1}): frozenset({1, 2}),
                   frozenset({4}): frozenset({2, 4}), frozenset({2}): frozenset({2, 4}), frozenset(): frozenset({2})}
    assert parents([frozenset({1, 2})], (2, 2)) == {frozenset({1, 2}): None}


def test_equal_to_single_calls(spark, rng):
    v = sparse(spark, random_sparse(rng, (5 * 2 * 4 * 3, 1), 0.6))
    dims = (5, 2, 4, 3)
    got = marginals(v, dims, SETS).collect()
    for number, axes in enumerate(SETS):
        names = [f"i{a}" for a in axes]
        want = {tuple(r) for r in marginal(v, dims, axes).df.collect()}
        own = [r for r in got if r["set"] == number]
        assert {(*(r[n] for n in names), r.val) for r in own} == want
        assert all(r[n] is None for r in own for n in {"i1", "i2", "i4"} - set(names))


def test_one_scan(spark, rng, tmp_path):
    write_parquet(sparse(spark, random_sparse(rng, (120, 1), 0.9, False)), str(tmp_path / "v"))
    df = sum_sets(reshape(read_parquet(spark, str(tmp_path / "v")), (5, 2, 4, 3)), SETS)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") >= 2


def test_no_entries_and_bad_axes(spark):
    empty = reshape(from_rows(spark, [], (6, 1)), (2, 3))
    assert [tuple(r) for r in sum_sets(empty, [[1], []]).collect()] == [(1, None, 0.0)]
    assert sum_axis(empty, [1, 2]).df.first()[0] == 0.0
    for bad in ([], [[3]]):
        with pytest.raises(ValueError):
            sum_sets(empty, bad)


@pytest.mark.parametrize("steps, every", [(1, 1), (4, 1), (7, 2), (6, 3), (5, 5)])
def test_history_equals_snapshots(spark, rng, steps, every):
    a = random_sparse(rng, (6, 6), 0.4)
    v = random_sparse(rng, (6, 1), 0.8)
    want = chain_apply([sparse(spark, a)], sparse(spark, v), steps, save_every=every)
    got = chain_history([sparse(spark, a)], sparse(spark, v), steps, every)
    assert got.steps == tuple(want.saved)
    assert np.array_equal(dense(got.state), dense(want.state))
    for step, state in want.saved.items():
        assert np.array_equal(dense(got.at(step)), dense(state))
    if want.saved:
        assert {tuple(r) for r in got.snapshots().collect()} == {tuple(r) for r in want.snapshots().collect()}
    else:
        assert got.snapshots() is None and got.changes.count() == 0
    with pytest.raises(ValueError):
        got.at(steps)


def test_storage_follows_the_changes(spark):
    """One entry of a thousand moves on at each step."""
    n = 1000
    rows = [(k, k, 1) for k in range(2, n)] + [(0, 1, 1), (1, 0, 1)]
    v = from_rows(spark, [(k, 0, k) for k in range(1, n)], (n, 1))
    with scratch(spark) as noted:
        got = chain_history([from_rows(spark, rows, (n, n))], v, 6, 1)
        counts = {r["step"]: r["count"] for r in got.changes.groupBy("step").count().collect()}
        assert counts == {1: n - 1, 2: 2, 3: 2, 4: 2, 5: 2}
        assert {r.gone for r in got.changes.where("step > 1").collect()} == {True, False}
    noted.release()


def test_changes_between_states(spark):
    before = from_rows(spark, [(0, 0, 1), (1, 0, 2), (2, 0, 3)], (4, 1))
    after = from_rows(spark, [(0, 0, 1), (1, 0, 5), (3, 0, 0)], (4, 1))
    got = {tuple(r) for r in changed(before, after).collect()}
    assert got == {(1, 0, 5.0, 0.0, False), (2, 0, 0.0, 0.0, True), (3, 0, 0.0, 0.0, False)}
    assert changed(after, after).count() == 0

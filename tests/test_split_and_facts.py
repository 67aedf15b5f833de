"""Hot columns stored apart, and facts noted while tables are written."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import dense, random_sparse, sparse

from coordloom.operators import SplitOperator, apply_split, kron, matmul
from coordloom.operators import joins, products
from coordloom.plans import chain_apply
from coordloom.sources import from_rows, store_bucketed, store_split
from coordloom.table import CooTable


def hot_matrix(rng, n=40):
    """One column holds a third of all entries."""
    a = random_sparse(rng, (n, n), 0.05)
    a[:, 7] = rng.integers(1, 5, n)
    return a


@pytest.mark.parametrize("width", [1, 3])
def test_split_equals_product(spark, rng, width):
    a, x = hot_matrix(rng), random_sparse(rng, (40, width), 0.7)
    op = store_split(sparse(spark, a), hot=20)
    assert isinstance(op, SplitOperator) and op.keys == 1
    assert np.array_equal(dense(op.light) + dense(op.heavy), a) and not dense(op.light)[:, 7].any()
    assert np.array_equal(dense(apply_split(op, sparse(spark, x))), a @ x)
    both = chain_apply([op, sparse(spark, a.T)], sparse(spark, x), 2).state
    assert np.array_equal(dense(both), a @ a.T @ a @ a.T @ x)
    with pytest.raises(ValueError):
        apply_split(op, sparse(spark, x[:39]))


def test_split_without_broadcast(spark, rng, no_broadcast):
    a, x = hot_matrix(rng), random_sparse(rng, (40, 2), 0.7)
    op = store_split(sparse(spark, a), hot=20)
    assert np.array_equal(dense(apply_split(op, sparse(spark, x))), a @ x)


def test_neither_part_of_the_operator_moves(spark, rng, no_broadcast):
    """Only the state is shuffled for the light part; the heavy one meets a broadcast."""
    op = store_split(sparse(spark, hot_matrix(rng, 200)), hot=60, buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256")
    state = from_rows(spark, [(k, 0, 1) for k in range(200)], (200, 1))
    plan = apply_split(op, state).df._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "im" in line]
    assert "SelectedBucketsCount: 4 out of 4" in plan and "BroadcastHashJoin" in plan
    assert len(scans) == 2
    for line_number, line in enumerate(plan.splitlines()):
        if "FileScan" in line and "Bucketed: true" in line:
            above = plan.splitlines()[max(0, line_number - 4):line_number]
            assert not any("Exchange hashpartitioning" in x for x in above)


def test_without_a_hot_column_it_is_bucketed(spark, rng):
    op = store_split(sparse(spark, random_sparse(rng, (9, 9))), hot=50)
    assert isinstance(op, CooTable) and op.bucketed == "col"


def test_entries_are_counted_on_writing(spark, rng, monkeypatch):
    a, b = random_sparse(rng, (6, 5), 0.5), random_sparse(rng, (4, 3), 0.5)
    stored = [sparse(spark, x) for x in (a, b)]
    stored = [CooTable(t.df, t.dims).store() for t in stored]
    assert [t.counted for t in stored] == [np.count_nonzero(x) for x in (a, b)]
    assert [t.transpose().bound for t in stored] == [t.counted for t in stored]

    def no_job(*_):
        raise AssertionError("a counting pass")

    monkeypatch.setattr(joins, "hot_keys", no_job)
    monkeypatch.setattr("coordloom.sources.columnar.heaviest", no_job)
    monkeypatch.setattr(products, "smaller_fitting", lambda *_: None)
    scheduler = spark.sparkContext._jsc.sc().dagScheduler()
    before = scheduler.numTotalJobs()
    got = kron(*stored, plan="blocks")
    assert scheduler.numTotalJobs() == before and np.array_equal(dense(got), np.kron(a, b))
    c = CooTable(sparse(spark, a.T).df, a.T.shape).store()
    assert np.array_equal(dense(matmul(stored[0], c)), a @ a.T)
    assert store_bucketed(stored[0]).heaviest == np.count_nonzero(a)


def test_stored_tables_keep_to_their_shape(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (5, 0, 1.0)], "row long, col long, re double")
    with pytest.raises(ValueError):
        CooTable(df, (5, 1)).store()
    assert CooTable(df, (6, 1)).store().counted == 2
    assert CooTable(df.limit(0), (6, 1)).store().counted == 0

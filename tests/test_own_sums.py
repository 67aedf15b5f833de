"""Sums of a symmetric product move as lists."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import dense, sparse

from coordloom.operators import joins, self_product


def matrix(rng, kind: str) -> np.ndarray:
    a = np.where(rng.random((40, 25)) < 0.4, rng.integers(-5, 6, (40, 25)), 0).astype(float)
    return a * {"small": 1, "large": 1000, "huge": 1 << 20, "fractions": 0.375}[kind]


@pytest.mark.parametrize("kind", ["small", "large", "huge", "fractions"])
@pytest.mark.parametrize("listed, task", [(1 << 10, 1 << 22), (12, 50), (1, 300)])
def test_sums_of_any_kind_of_number(spark, rng, no_broadcast, monkeypatch, kind, listed, task):
    """Lists of each kind of number, over several spans of columns, with keys of long lists."""
    monkeypatch.setattr(joins, "SPAN_BITS", 3)
    a = matrix(rng, kind)
    want = a @ a.T
    rows = joins.own_sums(sparse(spark, a).df, "col", "row", "re", listed=listed, task=task).collect()
    got = {(r.row, r.col): r.re for r in rows}
    assert len(got) == len(rows) and all(got[i, j] == want[i, j] for i, j in got)
    assert {(i, j) for i, j in np.argwhere(np.triu(want))} <= set(got)
    assert np.array_equal(dense(self_product(sparse(spark, a))), want)


def test_not_a_number_and_zero_sums(spark, no_broadcast):
    a = np.array([[np.nan, 1, 1], [0, 2, -2], [0, 3, 0]])
    got = dense(self_product(sparse(spark, a))).real
    assert np.isnan(got[0, 0]) and got[0, 1] == 0 and got[1, 1] == 8 and got[0, 2] == 3 and got[2, 1] == 6


def test_a_row_moves_once_for_a_task_and_span(spark, rng, no_broadcast):
    """Not once for each of its sums: 40 rows of one span and one task are 40 lists."""
    got = self_product(sparse(spark, matrix(rng, "small")))
    text = got.df._jdf.queryExecution().optimizedPlan().toString()
    moved = text.index("RepartitionByExpression", text.index("Generate"))
    assert "collect_list(_o" in text[moved:] and "collect_list(_o" not in text[:moved]

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pytest

from conftest import dense, random_sparse, sparse
from coordloom.operators import AxisOperator, kron, matmul, norm
from coordloom.plans import chain_apply, compose, run
from coordloom.session import discard, scratch, shared_folder
from coordloom.sources import from_rows, identity
from coordloom.table import CooTable

SIZES = (4, 5, 3)


def axis_arrays(rng) -> list[np.ndarray]:
    return [random_sparse(rng, (n, n), 0.6) for n in SIZES]


def test_report_with_full_and_with_axis_operators(spark, rng):
    """One operator on each axis of a state, two steps, marginals free and at a position."""
    arrays, v = axis_arrays(rng), random_sparse(rng, (60, 1), 0.7)
    step = np.kron(np.kron(arrays[0], arrays[1]), arrays[2])
    want = (np.linalg.matrix_power(step, 2) @ v).reshape(SIZES)
    full = [kron(kron(identity(spark, math.prod(SIZES[:k])), sparse(spark, u)),
                 identity(spark, math.prod(SIZES[k + 1:]))) for k, u in enumerate(arrays)]
    assert [op.dims for op in full] == [(60, 60)] * 3
    along = [AxisOperator(sparse(spark, u), SIZES, k) for k, u in enumerate(arrays, start=1)]
    for ops in (full, along):
        report = run(ops, sparse(spark, v), 2, dims=SIZES, measured=[1, 3], save_every=1)
        assert report["norm"].first()["norm"] == pytest.approx(np.linalg.norm(want))
        got = {(r["i1"], r["i3"]): r["val"] for r in report["marginal"].collect()}
        sums = (abs(want) ** 2).sum(axis=1)
        assert all(got.get(k, 0.0) == pytest.approx(x) for k, x in np.ndenumerate(sums))
        saved = report["snapshots"]
        assert {r["step"] for r in saved.select("step").distinct().collect()} == {1}
        assert norm(CooTable(saved, (60, 1))).first()["norm"] == pytest.approx(np.linalg.norm(step @ v))
    fixed = run(along, sparse(spark, v), 2, dims=SIZES, measured=[1], position=("?", 2, "?"))["marginal"]
    got = {r["i1"]: r["val"] for r in fixed.collect()}
    assert all(got.get(k, 0.0) == pytest.approx(x) for k, x in enumerate((abs(want[:, 2]) ** 2).sum(axis=1)))


def test_release_leaves_nothing(spark, rng, no_broadcast):
    from pathlib import Path

    def left() -> tuple[set, set]:
        folders = Path(shared_folder(spark).removeprefix("file:")) / "coordloom"
        return (set(folders.iterdir()) if folders.exists() else set(),
                {t.name for t in spark.catalog.listTables()})

    a, v = random_sparse(rng, (64, 64), 0.2), random_sparse(rng, (64, 1), 0.8)
    before = left()
    with scratch(spark) as stored:
        op, state = (replace(sparse(spark, x), stored=False) for x in (a, v))
        report = run([op], state, 3, save_every=1)
        wide = matmul(compose([op, op]), op, hot=4)
        blocks = kron(op, state, block=50)
    assert np.array_equal(dense(wide), a @ a @ a)  # readable until the release
    assert blocks.count() and report["norm"].first()["norm"] == pytest.approx(
        np.linalg.norm(np.linalg.matrix_power(a, 3) @ v))
    assert left() != before
    stored.release()
    assert left() == before


@pytest.fixture
def square(spark, rng):
    arrays = [random_sparse(rng, (6, 6), 0.4) for _ in range(3)]
    v = random_sparse(rng, (6, 1), 0.8)
    return arrays, v, [sparse(spark, a) for a in arrays], sparse(spark, v)


def test_last_operator_is_applied_first(square):
    (a, b, c), v, ops, state = square
    got = chain_apply(ops, state, 1).state
    assert np.array_equal(dense(got), a @ (b @ (c @ v)))


@pytest.mark.parametrize("per_cut", [1, 2, 100])
def test_cuts_change_nothing(square, per_cut):
    (a, b, c), v, ops, state = square
    got = chain_apply(ops, state, 3, products_per_cut=per_cut).state
    assert np.array_equal(dense(got), np.linalg.matrix_power(a @ b @ c, 3) @ v)


def test_state_too_large_to_broadcast(spark, rng, no_broadcast):
    a, v = random_sparse(rng, (64, 64), 0.2), random_sparse(rng, (64, 1), 0.8)
    got = chain_apply([sparse(spark, a)], sparse(spark, v), 3, products_per_cut=1).state
    joined = got.df._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[1]
    assert "Bucketed: true" in joined and joined.count("Exchange hashpartitioning") == 1
    assert np.array_equal(dense(got), np.linalg.matrix_power(a, 3) @ v)


def test_large_state_and_an_operator_too_skewed_to_bucket(spark, rng, no_broadcast):
    a = random_sparse(rng, (64, 64), 0.05)
    a[:, 3] = rng.integers(1, 4, 64)
    v = random_sparse(rng, (64, 1), 0.8)
    got = chain_apply([sparse(spark, a)], sparse(spark, v), 3).state
    assert np.array_equal(dense(got), np.linalg.matrix_power(a, 3) @ v)


def test_replaced_states_are_deleted(spark, square, monkeypatch):
    from pathlib import Path

    from coordloom.plans import chain

    gone = []

    def noted(session, path):
        discard(session, path)
        gone.append(path)

    monkeypatch.setattr(chain, "discard", noted)
    (a, b, c), v, ops, state = square
    result = chain_apply(ops, state, 3, save_every=1, products_per_cut=1)
    assert gone and not any(Path(p).exists() for p in gone)
    assert set(gone).isdisjoint(t.path for t in result.saved.values())
    assert np.array_equal(dense(result.state), np.linalg.matrix_power(a @ b @ c, 3) @ v)
    assert np.array_equal(dense(result.saved[1]), a @ b @ c @ v)
    with pytest.raises(ValueError):
        discard(spark, "/tmp/elsewhere")


def test_compose_equals_chain(square):
    _, _, ops, state = square
    once = chain_apply([compose(ops)], state, 2).state
    assert np.array_equal(dense(once), dense(chain_apply(ops, state, 2).state))


def test_repeated_operator_is_stored_once(square, monkeypatch):
    (a, _, _), v, ops, state = square
    op = replace(ops[0], stored=False)
    written = []
    store = CooTable.store
    monkeypatch.setattr(CooTable, "store", lambda t: written.append(t) or store(t))
    got = compose([op] * 3)
    assert len(written) == 1
    assert np.array_equal(dense(got), a @ a @ a)
    chain_apply([op, op], state, 1)
    assert len(written) == 2
    chain_apply(ops, state, 1)
    assert len(written) == 2


def test_snapshots(square):
    (a, b, c), v, ops, state = square
    step = a @ b @ c
    result = chain_apply(ops, state, 5, save_every=2)
    assert list(result.saved) == [2, 4]
    for k, t in result.saved.items():
        assert np.array_equal(dense(t), np.linalg.matrix_power(step, k) @ v)
    assert result.snapshots().columns == ["step", "row", "col", "re", "im"]
    assert chain_apply(ops, state, 2, save_every=2).snapshots() is None
    assert chain_apply(ops, state, 2).snapshots() is None


def test_wrong_arguments(spark, square):
    _, _, ops, state = square
    wide = from_rows(spark, [(0, 0, 1)], (4, 6))
    for call in (
        lambda: chain_apply(ops, state, 0),
        lambda: chain_apply([], state, 1),
        lambda: compose([]),
        lambda: chain_apply(ops, state, 2, save_every=0),
        lambda: chain_apply(ops, state, 2, save_every=3),
        lambda: chain_apply([wide], state, 2),
        lambda: chain_apply([ops[0], wide], state, 1),
        lambda: chain_apply(ops, state, 1, products_per_cut=0),
        lambda: run(ops, state, 1, dims=(6,)),
    ):
        with pytest.raises(ValueError):
            call()
    assert chain_apply([wide], state, 1).state.dims == (4, 1)


def test_long_chain_keeps_a_short_plan(spark):
    """100 products of a permutation come back to the start."""
    shift = from_rows(spark, [(i, (i + 1) % 20, 1) for i in range(20)], (20, 20))
    v = from_rows(spark, [(0, 0, 1), (3, 0, 2)], (20, 1))
    got = chain_apply([shift], v, 20, products_per_cut=5).state
    assert np.array_equal(dense(got), dense(v))
    assert math.isclose(norm(got).first()["norm"], math.sqrt(5))

"""Chains of operators applied to a state, step after step."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from coordloom.functions import COMPLEX
from coordloom.operators import (
    AxisOperator, SplitOperator, apply_on_axis, apply_split, axis_form, marginal, matmul, norm,
)
from coordloom.plans.ordering import SMALL, Order, cheapest_order
from coordloom.session import broadcast_entries, discard
from coordloom.sources import store_split
from coordloom.table import CooTable

Operator = CooTable | AxisOperator | SplitOperator

# Products planned as one query before the state is written out.
PRODUCTS_PER_CUT = 8


@dataclass(frozen=True)
class ChainResult:
    """The final state and, by step number, the states saved on the way."""

    state: CooTable
    saved: dict[int, CooTable] = field(default_factory=dict)

    def snapshots(self) -> DataFrame | None:
        """The saved states as ``step, row, col, re, im``; None if there are none."""
        parts = [t.entries().select(F.lit(step).alias("step"), "*")
                 for step, t in self.saved.items()]
        return reduce(DataFrame.unionByName, parts) if parts else None


def _apply(op: Operator, state: CooTable, product: str, eps: float, plan: str) -> CooTable:
    if isinstance(op, AxisOperator):
        return apply_on_axis(op.matrix, state, op.sizes, op.axis, product, eps, plan=plan)
    if isinstance(op, SplitOperator):
        return apply_split(op, state, product, eps)
    return matmul(op, state, product, eps, plan=plan)


def _check(ops: Sequence[Operator], dims: tuple[int, int], steps: int) -> None:
    if not ops:
        raise ValueError("a chain needs at least one operator")
    start = rows = dims[0]
    for op in reversed(ops):
        if op.dims[1] != rows:
            raise ValueError(f"an operator of {op.dims} meets a state of {rows} rows")
        rows = op.dims[0]
    if steps > 1 and rows != start:
        raise ValueError(f"a step turns {start} rows into {rows}; it cannot repeat")


def _stored_once(ops: Sequence[Operator], steps: int = 1,
                 store: Callable[[Operator], Operator] = lambda op: op.store()
                 ) -> list[Operator]:
    """The operators, those used more than once stored by one job each."""
    uses = Counter(id(op) for op in ops)
    distinct = {id(op): op for op in ops}
    stored = {key: store(op) if steps * uses[key] > 1 else op for key, op in distinct.items()}
    return [stored[id(op)] for op in ops]


def stored_operators(ops: Sequence[Operator], v: CooTable, steps: int) -> list[Operator]:
    """The operators of a chain as it stores them: what is applied more than once by one job
    each, bucketed by its join index if the state is too large to broadcast, hot columns apart."""
    large = v.dims[0] * v.dims[1] > broadcast_entries(v.df.sparkSession)
    return _stored_once(ops, steps, lambda op: store_split(op) if large and isinstance(op, CooTable)
                        and op.bucketed is None else op.store())


def _reads_state_twice(op: Operator) -> bool:
    """True if a product with a large state first looks for hot keys in it, or has two parts."""
    return isinstance(op, SplitOperator) or isinstance(op, CooTable) and op.bucketed is None


def chain_apply(ops: Sequence[Operator], v: CooTable, steps: int, *,
                save_every: int | None = None, product: str = COMPLEX, eps: float = 0.0,
                products_per_cut: int = PRODUCTS_PER_CUT, plan: str = "auto") -> ChainResult:
    """``steps`` times ``v <- U0 . (U1 . ( ... (Un . v)))``: the last operator first.

    With ``save_every=k`` the state at the start of step ``i`` is saved for each
    ``i`` above 0 that ``k`` divides; the final state is not among them. An
    operator that is applied more than once is stored first, bucketed by its join
    index if the state is too large to broadcast, with hot columns in a part of their own. The state is stored every
    ``products_per_cut`` products, so that neither the plan nor what a lost
    executor costs grows with the number of steps; a stored state that the next
    one replaces is deleted; the rest goes with the ``release()`` of a
    :func:`coordloom.session.scratch` block. ``plan`` is passed to every product.
    """
    steps = int(steps)
    if steps < 1:
        raise ValueError(f"steps must be at least 1, got {steps}")
    if products_per_cut < 1:
        raise ValueError(f"products_per_cut must be at least 1, got {products_per_cut}")
    if save_every is not None and not 1 <= save_every <= steps:
        raise ValueError(f"save_every must lie within 1..{steps}, got {save_every}")
    _check(ops, v.dims, steps)
    saving = save_every is not None and save_every < steps
    large = v.dims[0] * v.dims[1] > broadcast_entries(v.df.sparkSession)
    ops = stored_operators(ops, v, steps)
    state, pending, saved, replaceable = v, 0, {}, None
    for step in range(steps):
        due = saving and step > 0 and step % save_every == 0
        for op in reversed(ops):
            twice = _reads_state_twice(op) and (large or isinstance(op, SplitOperator))
            limit = 1 if twice else products_per_cut
            if due or pending >= limit:
                state, pending = state.store(), 0
                if replaceable is not None:
                    discard(state.df.sparkSession, replaceable)
                replaceable = None if due else state.path
            if due:
                saved[step], due = state, False
            state = _apply(op, state, product, eps, plan)
            pending += 1
    return ChainResult(state, saved)


def compose(ops: Sequence[CooTable], product: str = COMPLEX, eps: float = 0.0,
            order: str | Order = "auto") -> CooTable:
    """The single operator ``U0 . U1 . ... . Un``.

    Worth it if the product stays sparse and is applied many times. ``order="auto"``
    multiplies in the order that forms the fewest pairs: by the shapes if these are small, else
    by sketches of the operators, for which jobs run. ``"left"`` goes from left to right, and
    nested pairs of operator numbers say it themselves, such as ``(0, (1, 2))``.
    """
    if not ops:
        raise ValueError("a chain needs at least one operator")
    _check(ops, (ops[-1].dims[1], 1), 1)
    ops = _stored_once(ops)
    if order == "left":
        return reduce(lambda a, b: matmul(a, b, product, eps), ops)
    if order == "auto":
        if len(ops) > 2:
            ops = [op.store() if op.dims[0] * op.dims[1] > SMALL else op for op in ops]
        order = cheapest_order(ops)

    def formed(at: Order) -> tuple[CooTable, list[int]]:
        if isinstance(at, int):
            return ops[at], [at]
        (a, left), (b, right) = map(formed, at)
        return matmul(a, b, product, eps), left + right

    result, used = formed(order)
    if used != list(range(len(ops))):
        raise ValueError(f"the order {order} does not name the operators 0..{len(ops) - 1} in turn")
    return result


def simplified(ops: Sequence[Operator]) -> list[Operator]:
    """The operators, those of the form ``I (x) W (x) I`` as operators on one axis.

    Worth it before a chain of many steps: a product then costs what ``W`` does. Each
    operator is looked at once, however often it is in the list; runs jobs.
    """
    found = {id(op): op for op in ops}
    for key, op in found.items():
        if isinstance(op, CooTable):
            found[key] = axis_form(op) or op
    return [found[id(op)] for op in ops]


def run(ops: Sequence[Operator], v: CooTable, steps: int, *,
        dims: Iterable[int] | None = None, measured: Iterable[int] | None = None,
        position: Sequence[int | str | None] | None = None,
        save_every: int | None = None, product: str = COMPLEX,
        eps: float = 0.0) -> dict[str, DataFrame]:
    """One call: ``state``, its ``norm``, and on request ``marginal``, ``snapshots``.

    ``position`` takes the marginal at fixed coordinates. The final state is written once,
    as all the reports read it. What the call stores is deleted by the ``release()`` of a
    :func:`coordloom.session.scratch` block around it.
    """
    if (dims is None) != (measured is None) or position is not None and dims is None:
        raise ValueError("a marginal needs both dims and measured")
    result = chain_apply(ops, v, steps, save_every=save_every, product=product, eps=eps)
    state = result.state.store()
    report = {"state": state.entries(), "norm": norm(state)}
    if dims is not None:
        report["marginal"] = marginal(state, dims, measured, position).df
    snapshots = result.snapshots()
    if snapshots is not None:
        report["snapshots"] = snapshots
    return report

"""Matrix product, Kronecker product, and the product along one axis."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from coordloom.functions import COMPLEX, div, exact_sums, is_nonzero, multiply, ravel
from coordloom.functions.complex_numbers import check_product
from coordloom.operators.joins import (
    HOT_ENTRIES, PAIRS, block_pairing, blocks, keyed_join, own_sums, smaller_fitting,
)
from coordloom.table import CooTable, present


def _side(t: CooTable, prefix: str, **renamed: str) -> DataFrame:
    """The table's columns under names that do not clash in a join.

    The join index comes first on both sides: a table multiplied by its own
    transpose then needs one shuffle, which the other side reuses. A NULL index raises.
    """
    index = F.col if t.bucketed else present  # bucketed files were checked as they were written
    cols = [index(c).alias(n) for c, n in renamed.items()]
    return t.df.select(*cols, *(F.col(v).alias(f"{prefix}_{v}") for v in t.values))


def _value(t: CooTable, prefix: str) -> tuple[Column, Column | None]:
    return F.col(f"{prefix}_re"), F.col(f"{prefix}_im") if t.is_complex else None


def _named(re: Column, im: Column | None) -> list[Column]:
    return [re.alias("re")] + ([im.alias("im")] if im is not None else [])


def prune_zeros(t: CooTable, eps: float = 0.0) -> CooTable:
    """Without the entries that are zero in every part; NaN stays."""
    im = F.col("im") if t.is_complex else None
    return CooTable(t.df.where(is_nonzero(F.col("re"), im, eps)), t.dims,
                    unique=t.unique, at_most=t.at_most)


def _summed(pairs: DataFrame, row: Column, col: Column, value: list[Column],
            dims: tuple[int, int], eps: float, exact: bool = False) -> CooTable:
    formed = pairs.select(row.alias("row"), col.alias("col"), *value)
    names = ["re", "im"][:len(value)]
    df = exact_sums(formed, ["row", "col"], names) if exact else formed.groupBy("row", "col").agg(
        *(F.sum(n).alias(n) for n in names))
    return prune_zeros(CooTable(df, dims, unique=True), eps)


def _small_side(a: CooTable, b: CooTable) -> tuple[CooTable, CooTable, int | None]:
    """The operands and which one to broadcast, if any.

    A table that may repeat coordinates is proven small by its shape once they are
    merged; only that side is.
    """
    sides = (a.df, b.df)
    small = smaller_fitting(sides, (a.bound, b.bound))
    if small is None:
        small = smaller_fitting(sides, [t.dims[0] * t.dims[1] for t in (a, b)])
        a, b = (t.merged() if n == small else t for n, t in enumerate((a, b)))
    return a, b, small


def _check_plan(plan: str, *known: str) -> None:
    if plan not in ("auto", *known):
        raise ValueError(f"plan must be one of {('auto', *known)}, got {plan!r}")


def _too_few(a: CooTable, b: CooTable, hot: int | None) -> bool:
    """True if counts noted on writing rule hot keys out."""
    counts = a.counted, b.counted
    return None not in counts and max(counts) <= (hot or 0) and counts[0] * counts[1] <= PAIRS


def matmul(a: CooTable, b: CooTable, product: str = COMPLEX, eps: float = 0.0,
           hot: int | None = HOT_ENTRIES, plan: str = "auto", exact: bool = False) -> CooTable:
    """The product ``a . b``; sums that are zero in every part are dropped.

    ``product="complex"`` multiplies complex numbers; ``"componentwise"``
    multiplies real parts and imaginary parts apart. Partial sums are formed in
    the tasks that pair the entries, so only sums cross the second shuffle.

    If neither side can be broadcast, keys with more than ``hot`` entries are cut
    into cells, unless the shapes rule such keys out. Both sides are then read
    twice, so one that is not stored is written first, and the keys are counted: these
    jobs run when the product is built. ``hot=None`` leaves skew to adaptive execution
    instead. A side bucketed by the join index stays in place if neither its own
    heaviest index nor the other side's shape allows hot keys. ``plan`` forces one of
    the plans for large sides, ``"cells"`` or ``"in_place"``; the result is the same.
    ``exact`` adds the products of one coordinate without rounding, in whatever order; repeats
    of an operand's own coordinates are added up first, as in any product.
    """
    _check_plan(plan, "cells", "in_place")
    if a.dims[1] != b.dims[0]:
        raise ValueError(f"columns of {a.dims} differ from rows of {b.dims}")
    check_product(product)
    limit = hot or HOT_ENTRIES
    in_place = (a.bucketed == "col" and a.heaviest <= limit and b.unique and b.dims[1] <= limit
                or b.bucketed == "row" and b.heaviest <= limit and a.unique and a.dims[0] <= limit)
    if plan == "in_place" and not in_place:
        raise ValueError("no side is bucketed by the join index and free of hot keys")
    a, b, small = _small_side(a, b) if plan == "auto" else (a, b, None)
    if plan != "cells" and (in_place or max(a.dims[0], b.dims[1]) <= (hot or 0) or _too_few(a, b, hot)):
        hot = None
    if small is None and not in_place:
        a, b = a.merged(), b.merged()
        if hot is not None:
            a, b = a.store(), b.store()
    pairs = keyed_join(
        _side(a, "a", col="_k", row="_i"), _side(b, "b", row="_k", col="_j"), "_k",
        spread=(("_i",), ("_j",)), bounds=(a.bound, b.bound) if plan == "auto" else (None, None),
        hot=hot,
    )
    value = _named(*multiply(_value(a, "a"), _value(b, "b"), product))
    return _summed(pairs, F.col("_i"), F.col("_j"), value, (a.dims[0], b.dims[1]), eps, exact)


def self_product(t: CooTable, eps: float = 0.0, hot: int | None = HOT_ENTRIES) -> CooTable:
    """``t . transpose(t)`` of a real matrix, which is symmetric.

    Only pairs with row <= column are formed and summed; the sums are then mirrored. So
    half the pairs are joined and half the sums cross the second shuffle. A table that
    cannot be broadcast is stored, and its columns counted, when the product is built; its
    columns are then dealt in ranges, see :func:`~coordloom.operators.joins.own_sums`.
    """
    if t.is_complex:
        raise ValueError("self_product takes a real matrix")
    t = t.merged()
    bounds = (t.bound, t.bound)
    if smaller_fitting((t.df, t.df), bounds) is None and hot is not None:
        sums = own_sums(_side(t.store(), "a", col="_k", row="_i"), "_k", "_i", "a_re", hot)
        half = prune_zeros(CooTable(sums, (t.dims[0], t.dims[0]), unique=True), eps)
    else:
        pairs = keyed_join(
            _side(t, "a", col="_k", row="_i"), _side(t, "b", col="_k", row="_j"), "_k",
            spread=(("_i",), ("_j",)), bounds=bounds, hot=None,
        ).where(F.col("_i") <= F.col("_j"))
        half = _summed(pairs, F.col("_i"), F.col("_j"), [(F.col("a_re") * F.col("b_re")).alias("re")],
                       (t.dims[0], t.dims[0]), eps)
    # One row for the diagonal, two for the rest, without reading the sums twice.
    both = F.when(F.col("row") == F.col("col"), F.array(F.struct("row", "col"))).otherwise(
        F.array(F.struct("row", "col"), F.struct(F.col("col").alias("row"), F.col("row").alias("col"))))
    df = half.df.select(F.explode(both).alias("at"), "re").select("at.row", "at.col", "re")
    return CooTable(df, half.dims, unique=True)


def kron(a: CooTable, b: CooTable, product: str = COMPLEX,
         entries: tuple[int | None, int | None] = (None, None),
         block: int = HOT_ENTRIES, plan: str = "auto") -> CooTable:
    """The Kronecker product: every entry of ``a`` with every entry of ``b``.

    Zero products are kept. A side proven small is broadcast. Otherwise both are
    dealt into blocks of about ``block`` entries, for which the entry counts are
    needed: give them as ``entries``, or a side is stored and counted first. Counts
    that are given set the number of blocks and nothing else, so wrong ones cost time only.
    ``plan="blocks"`` takes the blocks for small sides too.
    """
    check_product(product)
    _check_plan(plan, "blocks")
    dims = (a.dims[0] * b.dims[0], a.dims[1] * b.dims[1])
    small = smaller_fitting((a.df, b.df), (a.bound, b.bound)) if plan == "auto" else None
    bounds = [a.bound, b.bound]
    counts = [1, 1]
    if small is None:
        a, b = (t if n is not None else t.store() for n, t in zip(entries, (a, b)))
        counted = [None if n is not None else t.count() for n, t in zip(entries, (a, b))]  # no job: stored
        bounds = [t.bound if n is None else n for n, t in zip(counted, (a, b))]
        counts = [blocks(n if n is not None else c, block) for n, c in zip(entries, counted)]
    pairs = block_pairing(
        _side(a, "a", row="_ai", col="_aj"), _side(b, "b", row="_bi", col="_bj"),
        left_id=["_ai", "_aj"], right_id=["_bi", "_bj"],
        left_blocks=counts[0], right_blocks=counts[1],
        small=small,
    )
    row = ravel([F.col("_ai"), F.col("_bi")], (a.dims[0], b.dims[0]))
    col = ravel([F.col("_aj"), F.col("_bj")], (a.dims[1], b.dims[1]))
    value = _named(*multiply(_value(a, "a"), _value(b, "b"), product))
    at_most = bounds[0] * bounds[1] if None not in bounds else None
    return CooTable(pairs.select(row.alias("row"), col.alias("col"), *value), dims,
                    unique=a.unique and b.unique, full=a.full and b.full, at_most=at_most)


@dataclass(frozen=True)
class AxisOperator:
    """``matrix`` acting on one axis of a row-major state, all other axes kept.

    It stands for ``I (x) matrix (x) I`` without building it: the state's own
    entries carry the other coordinates along. Axes count from 1.
    """

    matrix: CooTable
    sizes: tuple[int, ...]
    axis: int

    def __post_init__(self) -> None:
        object.__setattr__(self, "sizes", tuple(int(s) for s in self.sizes))
        if not 1 <= self.axis <= len(self.sizes):
            raise ValueError(f"axis {self.axis} is not within rank {len(self.sizes)}")
        if self.matrix.dims[1] != self.sizes[self.axis - 1]:
            raise ValueError(
                f"axis {self.axis} has size {self.sizes[self.axis - 1]}, "
                f"the matrix takes {self.matrix.dims[1]}"
            )

    @property
    def dims(self) -> tuple[int, int]:
        size = math.prod(self.sizes)
        return size // self.matrix.dims[1] * self.matrix.dims[0], size

    def store(self) -> AxisOperator:
        return AxisOperator(self.matrix.store(), self.sizes, self.axis)


@dataclass(frozen=True)
class SplitOperator:
    """A stored operator whose hot columns lie apart: ``light`` is bucketed by column and has no
    hot one, ``heavy`` holds the entries of ``keys`` hot columns, laid out by row."""

    light: CooTable
    heavy: CooTable
    hot_columns: DataFrame
    keys: int

    @property
    def dims(self) -> tuple[int, int]:
        return self.light.dims

    def store(self) -> SplitOperator:
        return self


def apply_split(op: SplitOperator, v: CooTable, product: str = COMPLEX, eps: float = 0.0,
                exact: bool = False) -> CooTable:
    """``op . v`` with neither part of the operator moved.

    The state moves to the buckets of the light columns. What it has at the hot columns, at
    most ``keys`` rows of it, is broadcast to the heavy part if that is proven small; otherwise
    that part is multiplied by the plan that cuts hot keys into cells.
    """
    if op.dims[1] != v.dims[0]:
        raise ValueError(f"columns of {op.dims} differ from rows of {v.dims}")
    check_product(product)
    v = v.merged()
    picked = v.df.join(op.hot_columns.withColumnRenamed("col", "row"), "row", "left_semi")
    few = CooTable(picked, v.dims, unique=True, at_most=op.keys * v.dims[1])
    parts = []
    for matrix, state, hot in ((op.light, v, None), (op.heavy, few, HOT_ENTRIES)):
        small = smaller_fitting((matrix.df, state.df), (None, state.bound)) if matrix is op.heavy else None
        if matrix is op.heavy and small is None:
            state = state.store()
        pairs = keyed_join(_side(matrix, "a", col="_k", row="_i"), _side(state, "b", row="_k", col="_j"), "_k",
                           spread=(("_i",), ("_j",)), hot=hot,
                           bounds=(None, state.bound if matrix is op.heavy else None))
        value = _named(*multiply(_value(matrix, "a"), _value(state, "b"), product))
        parts.append(pairs.select("_i", "_j", *value))
    values = [F.col(n) for n in parts[0].columns[2:]]
    return _summed(parts[0].unionAll(parts[1]), F.col("_i"), F.col("_j"), values, (op.dims[0], v.dims[1]), eps, exact)


def apply_on_axis(matrix: CooTable, v: CooTable, sizes: Sequence[int], axis: int,
                  product: str = COMPLEX, eps: float = 0.0,
                  hot: int | None = HOT_ENTRIES, plan: str = "auto") -> CooTable:
    """``(I (x) matrix (x) I) . v`` with ``matrix`` on axis ``axis`` of ``v``'s rows.

    ``plan="cells"`` forces the plan that cuts hot keys into cells.
    """
    _check_plan(plan, "cells")
    op = AxisOperator(matrix, tuple(sizes), axis)
    if op.dims[1] != v.dims[0]:
        raise ValueError(f"sizes {op.sizes} differ from the {v.dims[0]} rows")
    check_product(product)
    inner = math.prod(op.sizes[axis:])
    matrix, v, small = _small_side(matrix, v) if plan == "auto" else (matrix, v, None)
    if small is None:
        matrix, v = matrix.merged(), v.merged()
        if hot is not None:
            matrix, v = matrix.store(), v.store()
    state = _side(v, "b", row="_r", col="_j").withColumn(
        "_k", div(F.col("_r"), inner) % F.lit(matrix.dims[1]).cast("bigint"))
    pairs = keyed_join(
        _side(matrix, "a", col="_k", row="_i"), state, "_k",
        spread=(("_i",), ("_r", "_j")), hot=hot,
        bounds=(matrix.bound, v.bound) if plan == "auto" else (None, None),
    )
    outer = div(F.col("_r"), inner * matrix.dims[1])
    low = F.col("_r") % F.lit(inner).cast("bigint")
    row = ravel([outer, F.col("_i"), low], (1, matrix.dims[0], inner))
    value = _named(*multiply(_value(matrix, "a"), _value(v, "b"), product))
    return _summed(pairs, row, F.col("_j"), value, (op.dims[0], v.dims[1]), eps)

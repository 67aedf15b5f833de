"""From a flat vector to axes and back, sums over axes, marginals."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from coordloom.functions import exact_sums, ravel as ravel_index, strides, unravel
from coordloom.operators.reductions import abs_square
from coordloom.table import CooTable, TensorTable, axis_names, check_dims

FREE = "?"


def _on_axes(flat: DataFrame, dims: Sequence[int], values: dict[str, str]) -> DataFrame:
    coords = unravel(F.col("row"), dims)
    return flat.select(
        *(c.alias(n) for c, n in zip(coords, axis_names(len(dims)))),
        *(F.col(v).alias(n) for v, n in values.items()),
    )


def reshape(v: CooTable, dims: Iterable[int]) -> TensorTable:
    """The rows of ``v`` as coordinates of an array of shape ``dims``, row-major.

    A column index is dropped. A real vector gives the value column ``val``; a
    complex one keeps ``re`` and ``im``.
    """
    dims = check_dims(dims)
    if math.prod(dims) != v.dims[0]:
        raise ValueError(f"shape {dims} has {math.prod(dims)} cells, the vector {v.dims[0]}")
    values = {"re": "re", "im": "im"} if v.is_complex else {"re": "val"}
    flat = v.df.select("row", *values)
    return TensorTable(_on_axes(flat, dims, values), dims, axis_names(len(dims)),
                       tuple(values.values()), flat)


def ravel(t: TensorTable) -> CooTable:
    """The array as a vector; the inverse of :func:`reshape`."""
    row = ravel_index([F.col(a) for a in t.axes], t.dims) if t.axes else F.lit(0)
    names = {"val": "re"}
    df = t.df.select(row.cast("bigint").alias("row"), F.lit(0).cast("bigint").alias("col"),
                     *(F.col(v).alias(names.get(v, v)) for v in t.values))
    return CooTable(df, (math.prod(t.dims), 1))


def check_axes(axes: Iterable[int], rank: int) -> set[int]:
    out = {int(a) for a in axes}
    wrong = sorted(a for a in out if not 1 <= a <= rank)
    if wrong:
        raise ValueError(f"axes {wrong} are not within 1..{rank}")
    return out


def _check_position(position: Sequence[int | str | None] | None,
                    dims: Sequence[int]) -> dict[int, int]:
    """Fixed coordinate by axis number."""
    if position is None:
        return {}
    if len(position) != len(dims):
        raise ValueError(f"a position for rank {len(dims)} needs {len(dims)} values, got {len(position)}")
    fixed = {k: int(p) for k, p in enumerate(position, start=1) if p not in (FREE, None)}
    for axis, at in fixed.items():
        if not 0 <= at < dims[axis - 1]:
            raise ValueError(f"position {at} is not on axis {axis} of size {dims[axis - 1]}")
    return fixed


def _at_position(t: TensorTable, fixed: dict[int, int]) -> DataFrame:
    """The entries at the fixed coordinates.

    Coordinates fixed on the leading axes bound the flat index, and a range on a
    stored column lets the scan skip row groups; the rest is a plain filter.
    """
    df = t.df
    leading = 0
    while leading + 1 in fixed:
        leading += 1
    if leading and t.flat is not None:
        width = strides(t.dims)[leading - 1]
        low = sum(fixed[k] * strides(t.dims)[k - 1] for k in range(1, leading + 1))
        flat = t.flat.where((F.col("row") >= low) & (F.col("row") < low + width))
        values = dict(zip([c for c in t.flat.columns if c != "row"], t.values))
        df = _on_axes(flat, t.dims, values)
    for axis, at in fixed.items():
        df = df.where(F.col(t.axes[axis - 1]) == at)
    return df


def sum_axis(t: TensorTable, axes: Iterable[int],
             position: Sequence[int | str | None] | None = None, exact: bool = False) -> TensorTable:
    """Sum over ``axes``; keep only entries at ``position`` where one is given.

    ``position`` holds one value per axis, ``"?"`` for a free one; fixed axes
    leave the result. All axis numbers refer to the array as given. One group-by
    does it whatever the number of axes; zero sums are kept. ``exact`` adds without
    rounding: the same sums to the last bit however the entries are dealt over tasks.
    """
    if t.values != ("val",):
        raise ValueError("sum_axis takes real values; use abs_square first")
    fixed = _check_position(position, t.dims)
    gone = check_axes(axes, t.rank) | set(fixed)
    kept = [k for k in range(1, t.rank + 1) if k not in gone]
    names = tuple(t.axes[k - 1] for k in kept)
    total = F.sum("val").alias("val") if names else F.coalesce(
        F.sum("val"), F.lit(0.0)).alias("val")
    entries = _at_position(t, fixed)
    if exact:
        sums = exact_sums(entries, names, ["val"])
        df = sums if names else sums.agg(F.coalesce(F.max("val"), F.lit(0.0)).alias("val"))
    else:
        df = entries.groupBy(*names).agg(total)
    return TensorTable(df, tuple(t.dims[k - 1] for k in kept), names)


def marginal(v: CooTable, dims: Iterable[int], measured: Iterable[int],
             position: Sequence[int | str | None] | None = None, exact: bool = False) -> TensorTable:
    """Squared magnitudes of a state, summed over every axis not measured.

    A measured axis that ``position`` fixes is dropped like in :func:`sum_axis`.
    One narrow projection and one group-by; unmeasured coordinates are never
    computed.
    """
    t = reshape(abs_square(v), dims)
    keep = check_axes(measured, t.rank)
    return sum_axis(t, set(range(1, t.rank + 1)) - keep, position, exact)


def renamed(t: TensorTable) -> TensorTable:
    """The array with its axes numbered afresh, ``i1`` to ``in``."""
    names = axis_names(t.rank)
    df = t.df.select(*(F.col(a).alias(n) for a, n in zip(t.axes, names)), *t.values)
    return replace(t, df=df, axes=names)

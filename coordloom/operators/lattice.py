"""Several sums of one array over different axes, from one scan.

The sets of axes that are kept form a lattice. A sum over more axes is a sum of sums, so each
set is formed from the smallest result that still has its axes; only the first one reads the
array. All are one plan, in which Spark reuses the shuffle of a parent for its children.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from coordloom.operators.reductions import abs_square
from coordloom.operators.tensors import check_axes, reshape
from coordloom.table import CooTable, TensorTable

Axes = frozenset


def parents(sets: Iterable[Axes], dims: Sequence[int]) -> dict[Axes, Axes | None]:
    """For every set, and for what they have together, the smallest set to form it from.

    In an order in which parents come first; None is the array itself.
    """
    wanted = set(sets)
    root = Axes().union(*wanted)

    def cells(axes: Axes) -> int:
        return math.prod(dims[a - 1] for a in axes)

    placed: dict[Axes, Axes | None] = {root: None}
    for axes in sorted(wanted - {root}, key=lambda s: (-len(s), -cells(s), sorted(s))):
        placed[axes] = min((p for p in placed if axes < p), key=lambda p: (cells(p), len(p), sorted(p)))
    return placed


def sum_sets(t: TensorTable, kept: Sequence[Iterable[int]]) -> DataFrame:
    """``set, axes .., val``: sums of a real array for several sets of axes that are kept.

    ``set`` is the place of the set in ``kept``, from 0. There is a column for every axis that
    any set keeps, NULL where a set does not keep it; a set of no axes has one row, 0.0 for an
    array without entries. The same as :func:`sum_axis` over all other axes, one after the other.
    """
    if t.values != ("val",):
        raise ValueError("sum_sets takes real values; use abs_square first")
    sets = [Axes(check_axes(axes, t.rank)) for axes in kept]
    if not sets:
        raise ValueError("at least one set of axes is needed")
    formed: dict[Axes, DataFrame] = {}
    for axes, parent in parents(sets, t.dims).items():
        names = [t.axes[a - 1] for a in sorted(axes)]
        total = F.sum("val").alias("val") if names else F.coalesce(F.sum("val"), F.lit(0.0)).alias("val")
        formed[axes] = (t.df if parent is None else formed[parent]).groupBy(*names).agg(total)
    every = [t.axes[a - 1] for a in sorted(Axes().union(*sets))]

    def numbered(number: int, axes: Axes) -> DataFrame:
        own = {t.axes[a - 1] for a in axes}
        return formed[axes].select(F.lit(number).alias("set"), *(
            F.col(a) if a in own else F.lit(None).cast("bigint").alias(a) for a in every), "val")

    return reduce(DataFrame.unionAll, (numbered(n, axes) for n, axes in enumerate(sets)))


def marginals(v: CooTable, dims: Iterable[int], measured: Sequence[Iterable[int]]) -> DataFrame:
    """Squared magnitudes of a state, summed for several sets of measured axes; see
    :func:`sum_sets`. The state is read once."""
    return sum_sets(reshape(abs_square(v), dims), measured)

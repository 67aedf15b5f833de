"""Kronecker structure found in a stored matrix: ``I (x) W (x) I`` and ``A (x) B``.

A product with ``I(a) (x) W (x) I(b)`` costs as little as one with ``W`` if its form is
known. It is known from the entries: rows and columns lie in the same of ``a`` blocks,
leave the same remainder by ``b``, and the value depends on what is left of them only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from coordloom.functions import COMPLEX, div, multiply
from coordloom.operators.products import AxisOperator
from coordloom.table import CooTable

# Tests of one aggregate.
_AT_ONCE = 128


def _divisors(n: int) -> list[int]:
    """Divisors of ``n``, the largest first, without 1."""
    low = [d for d in range(1, math.isqrt(n) + 1) if n % d == 0]
    return sorted({*low, *(n // d for d in low)} - {1}, reverse=True)


def _holding(t: CooTable, tests: dict[int, Column]) -> list[int]:
    """The numbers whose test holds for every entry, one look at the entries for many."""
    found, names = [], list(tests)
    for first in range(0, len(names), _AT_ONCE):
        some = names[first:first + _AT_ONCE]
        row = t.df.agg(*(F.bool_and(tests[n]).alias(f"t{n}") for n in some)).first()
        found += [n for n in some if row[f"t{n}"]]
    return found


def _mod(index: str, by: int) -> Column:
    return F.col(index) % F.lit(by).cast("bigint")


def _folded(t: CooTable, row: Column, col: Column, times: int, dims: tuple[int, int]) -> CooTable | None:
    """One entry for all entries at ``row, col``, if there are ``times`` of each with one value."""
    values = t.values
    groups = t.df.select(row.alias("row"), col.alias("col"), *values).groupBy("row", "col").agg(
        F.count("*").alias("_n"), *(F.min(v).alias(v) for v in values), *(F.max(v).alias(f"_{v}") for v in values))
    same = F.col("_n") == times
    for v in values:
        same = same & (F.col(v) == F.col(f"_{v}"))
    folded = CooTable(groups.select("row", "col", *values, same.alias("_same")), dims, unique=True).store()
    if not folded.df.agg(F.bool_and("_same")).first()[0]:
        return None
    return CooTable(folded.df.drop("_same"), dims, unique=True, stored=True, path=folded.path)


def axis_form(t: CooTable) -> AxisOperator | None:
    """``t`` as an operator on one axis, if it is ``I(a) (x) W (x) I(b)`` with ``a * b > 1``.

    Of several forms that with the largest ``a`` and then the largest ``b``. Values have to be
    equal exactly; repeated coordinates are added up before. Each form that is possible by the
    indices takes one grouping of the entries, which get fewer with each form found. None if
    there is no such form, and for a matrix without entries.
    """
    t = t.merged().store()
    rows, cols = t.dims
    common = _divisors(math.gcd(rows, cols))
    if not common or t.df.isEmpty():
        return None
    count = t.count()
    blocks = _holding(t, {a: div(F.col("row"), rows // a) == div(F.col("col"), cols // a)
                          for a in common if count % a == 0})
    outer = 1
    for a in blocks:
        inner = _folded(t, _mod("row", rows // a), _mod("col", cols // a), a, (rows // a, cols // a))
        if inner is not None:
            outer, t, count = a, inner, count // a
            break
    rows, cols = t.dims
    remainders = _holding(t, {b: _mod("row", b) == _mod("col", b)
                              for b in _divisors(math.gcd(rows, cols)) if count % b == 0})
    for b in remainders:
        outermost = _folded(t, div(F.col("row"), b), div(F.col("col"), b), b, (rows // b, cols // b))
        if outermost is not None:
            return AxisOperator(outermost, (outer, cols // b, b), 2)
    return AxisOperator(t, (outer, cols, 1), 2) if outer > 1 else None


def kron_factors(t: CooTable, left: tuple[int, int], rtol: float = 1e-12) -> tuple[CooTable, CooTable] | None:
    """``(A, B)`` with ``A (x) B = t`` and ``A`` of the dimensions ``left``, or None.

    The first entry that is not zero is a pivot: the entries in its place of every block
    make ``A``, divided by it, those of its block make ``B``. Every entry of ``t`` must then be
    the product of two of theirs, to a relative error of ``rtol``, and their number the product
    of theirs. One row is collected, the pivot.
    """
    if any(d % n for d, n in zip(t.dims, left)) or min(left) < 1:
        raise ValueError(f"{left} does not divide {t.dims}")
    t = t.merged().store()
    right = t.dims[0] // left[0], t.dims[1] // left[1]
    values = [F.col("re"), F.col("im") if t.is_complex else F.lit(0.0)]
    split = t.df.select(
        div(F.col("row"), right[0]).alias("i"), _mod("row", right[0]).alias("j"),
        div(F.col("col"), right[1]).alias("k"), _mod("col", right[1]).alias("l"),
        values[0].alias("re"), values[1].alias("im"))
    first = split.where((F.col("re") != 0) | (F.col("im") != 0)).agg(
        F.min(F.struct("i", "k", "j", "l", "re", "im")).alias("p")).first()["p"]
    if first is None:
        return None
    size = first["re"] ** 2 + first["im"] ** 2
    over = first["re"] / size, -first["im"] / size

    def made(part: DataFrame, dims: tuple[int, int], row: str, col: str, scale: tuple[float, float]) -> CooTable:
        re, im = multiply((F.col("re"), F.col("im")), (F.lit(scale[0]), F.lit(scale[1])), COMPLEX)
        parts = [re.alias("re"), im.alias("im")] if t.is_complex else [re.alias("re")]
        return CooTable(part.select(F.col(row).alias("row"), F.col(col).alias("col"), *parts), dims,
                        unique=True).store()

    a = made(split.where((F.col("j") == first["j"]) & (F.col("l") == first["l"])), left, "i", "k", over)
    b = made(split.where((F.col("i") == first["i"]) & (F.col("k") == first["k"])), right, "j", "l", (1.0, 0.0))
    n = t.count()
    if n != a.count() * b.count():
        return None
    left_side = a.entries().select(F.col("row").alias("i"), F.col("col").alias("k"),
                                   F.col("re").alias("a_re"), F.col("im").alias("a_im"))
    right_side = b.entries().select(F.col("row").alias("j"), F.col("col").alias("l"),
                                    F.col("re").alias("b_re"), F.col("im").alias("b_im"))
    re, im = multiply((F.col("a_re"), F.col("a_im")), (F.col("b_re"), F.col("b_im")), COMPLEX)
    off = F.hypot(re - F.col("re"), im - F.col("im"))
    fits = split.join(left_side, ["i", "k"]).join(right_side, ["j", "l"]).where(
        off <= rtol * F.hypot("re", "im"))
    return (a, b) if fits.count() == n else None

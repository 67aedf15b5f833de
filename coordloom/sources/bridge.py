"""From ordinary tables and small literals to sparse matrices."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from coordloom.functions.indexing import strides
from coordloom.session import local_table
from coordloom.table import CooTable, check_dims, within


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _required(c: Column, dtype: str, name: str) -> Column:
    """The column, where a NULL is an input error."""
    return F.coalesce(c, F.raise_error(F.lit(f"NULL in matrix column {name}")).cast(dtype))


def to_coo(df: DataFrame, row: Column | str, col: Column | str, re: Column | str,
           im: Column | str | None = None, dims: tuple[int, int] | None = None,
           key: bool = False, merge: bool = True) -> CooTable:
    """A matrix from the rows of any table; repeated coordinates are added up.

    A NULL value or index raises, and so does an index outside given ``dims``, so that
    the shape bounds the number of entries. ``key=True`` states that the coordinates are
    a key of the table, not repeated: no group-by is needed. ``merge=False`` leaves
    repeated coordinates as they are; a product adds them up in any case, so an
    operand with few repeats saves a shuffle. Without ``dims`` the largest
    indices are looked up by a job.
    """
    given = {"re": re} if im is None else {"re": re, "im": im}
    values = {n: _required(_column(c).cast("double"), "double", n) for n, c in given.items()}
    index = {n: _column(c).cast("bigint") for n, c in (("row", row), ("col", col))}
    out = df.select(*(c.alias(n) for n, c in (index | values).items()))
    if merge and not key:
        out = out.groupBy("row", "col").agg(*(F.sum(v).alias(v) for v in values))
    if dims is None:
        dims = measured_dims(out)
    return CooTable(within(out, ("row", "col"), check_dims(dims)), dims, unique=merge or key)


def measured_dims(df: DataFrame) -> tuple[int, int]:
    """Smallest dimensions that hold every entry; runs a one-row aggregate."""
    top = df.agg(F.max("row"), F.max("col")).first()
    if top[0] is None:
        raise ValueError("an empty table has no measurable dimensions; give dims")
    return top[0] + 1, top[1] + 1


def from_rows(spark: SparkSession, rows: Iterable[Sequence[float]],
              dims: tuple[int, int]) -> CooTable:
    """A small matrix written entry by entry: ``(row, col, re[, im])``."""
    data = [(int(r[0]), int(r[1]), float(r[2]), float(r[3]) if len(r) > 3 else 0.0)
            for r in rows]
    if any(not (0 <= r < dims[0] and 0 <= c < dims[1]) for r, c, _, _ in data):
        raise ValueError(f"an entry lies outside {dims}")
    df = local_table(spark, data, row=pa.int64(), col=pa.int64(), re=pa.float64(),
                     im=pa.float64())
    if not any(im for *_, im in data):
        df = df.drop("im")
    unique = len({d[:2] for d in data}) == len(data)
    return CooTable(df, dims, unique=unique, at_most=len(data), stored=True)


def basis_vector(spark: SparkSession, dims: Sequence[int],
                 amplitudes: Mapping[Sequence[int], complex]) -> CooTable:
    """A vector with few non-zeros, given at n-dimensional coordinates."""
    dims = check_dims(dims)
    rows = []
    for coords, amplitude in amplitudes.items():
        if len(coords) != len(dims) or any(not 0 <= c < d for c, d in zip(coords, dims)):
            raise ValueError(f"coordinate {tuple(coords)} is not inside {dims}")
        index = sum(c * s for c, s in zip(coords, strides(dims)))
        rows.append((index, 0, complex(amplitude).real, complex(amplitude).imag))
    size = dims[0] * strides(dims)[0]
    return from_rows(spark, rows, (size, 1))

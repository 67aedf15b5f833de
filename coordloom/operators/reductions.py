"""Norm and squared magnitude."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from coordloom.functions import exact_sums, magnitude_squared
from coordloom.table import CooTable


def _magnitude_squared(t: CooTable):
    return magnitude_squared(F.col("re"), F.col("im") if t.is_complex else None)


def norm(t: CooTable, exact: bool = False) -> DataFrame:
    """The Frobenius norm as one row ``norm DOUBLE``; 0.0 for an empty table.

    Repeated coordinates count as separate entries. ``exact`` adds the squares without
    rounding, so that the result does not depend on how the entries are dealt over tasks.
    """
    if exact:
        total = exact_sums(t.df.select(_magnitude_squared(t).alias("norm")), [], ["norm"])
        return total.agg(F.coalesce(F.sqrt(F.max("norm")), F.lit(0.0)).alias("norm"))
    return t.df.agg(
        F.coalesce(F.sqrt(F.sum(_magnitude_squared(t))), F.lit(0.0)).alias("norm"))


def abs_square(t: CooTable) -> CooTable:
    """``re*re + im*im`` of every entry, as a real table of the same shape."""
    df = t.df.select("row", "col", _magnitude_squared(t).alias("re"))
    return replace(t, df=df, stored=False, bucketed=None, path=None)

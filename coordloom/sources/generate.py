"""Generated matrices and vectors; all come from distributed ranges."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import SparkSession, functions as F

from coordloom.functions import ravel, unravel
from coordloom.table import CooTable, check_dims


def identity(spark: SparkSession, n: int) -> CooTable:
    """Ones on the diagonal of an ``n`` by ``n`` matrix."""
    df = spark.range(n).select(F.col("id").alias("row"), F.col("id").alias("col"),
                               F.lit(1.0).alias("re"))
    return CooTable(df, (n, n), unique=True, at_most=n, stored=True)


def uniform_vector(spark: SparkSession, n: int) -> CooTable:
    """``1/sqrt(n)`` in every row."""
    df = spark.range(n).select(
        F.col("id").alias("row"), F.lit(0).cast("bigint").alias("col"),
        F.lit(1.0 / math.sqrt(n)).alias("re"))
    return CooTable(df, (n, 1), full=True, stored=True)


def cyclic_shift(spark: SparkSession, sizes: Sequence[int],
                 offsets: Sequence[int] | None = None) -> CooTable:
    """The permutation that moves every axis of an array by its offset, round the edge.

    Row and column are flat row-major indices of shape ``sizes``: row ``x`` takes what
    column ``(x + offset) mod size`` holds, axis by axis. Offsets default to 1.
    """
    sizes = check_dims(sizes)
    offsets = tuple(int(o) for o in offsets) if offsets is not None else (1,) * len(sizes)
    if len(offsets) != len(sizes):
        raise ValueError(f"{len(sizes)} axes but offsets {offsets}")
    n = math.prod(sizes)
    moved = [F.pmod(x + F.lit(o), F.lit(s).cast("bigint"))
             for x, s, o in zip(unravel(F.col("id"), sizes), sizes, offsets)]
    df = spark.range(n).select(F.col("id").alias("row"), ravel(moved, sizes).alias("col"),
                               F.lit(1.0).alias("re"))
    return CooTable(df, (n, n), unique=True, at_most=n, stored=True)

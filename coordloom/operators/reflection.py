"""Reflection of a vector at its mean, with some rows flipped first, once or many times.

One step is ``y = 2*mean(s*x) - s*x`` over all ``N`` rows, ``s`` being -1 on the rows of
a second table and 1 elsewhere. It is affine in ``x`` with one shared scalar, so any
number of steps is ``sign * x + shift`` per row. The shifts depend on the data only
through two sums and the number of flipped rows: a single aggregate, a recurrence over
two numbers, and a single projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from coordloom.table import CooTable, present, within


def densify(v: CooTable) -> CooTable:
    """A vector with a row for every index, zeros included; repeated rows are added up.

    An index outside the dimensions raises, whatever join Spark picks.
    """
    if v.full:
        return v
    if v.dims[1] != 1:
        raise ValueError(f"a vector has one column, got dimensions {v.dims}")
    index = v.df.sparkSession.range(v.dims[0]).select(F.col("id").alias("row"))
    entries = within(v.merged().df, ("row", "col"), v.dims).select(present("row").alias("row"), *v.values)
    filled = index.join(entries, "row", "left").select(
        "row", F.lit(0).cast("bigint").alias("col"),
        *(F.coalesce(c, F.lit(0.0)).alias(c) for c in v.values))
    return CooTable(filled, v.dims, full=True)


def _shifts(plain: Column, flipped: Column, n: int, n_flipped: Column, steps: int) -> Column:
    """Shift of the plain and of the flipped rows after ``steps`` steps.

    Each step adds ``2*mean`` to the negated plain rows and to the unchanged
    flipped rows; the two sums follow the same rule.
    """
    def struct(p: Column, m: Column, sp: Column, sm: Column) -> Column:
        return F.struct(p.alias("plain_sum"), m.alias("flipped_sum"),
                        sp.alias("plain_shift"), sm.alias("flipped_shift"))

    def step(s: Column, _: Column) -> Column:
        mean2 = 2.0 * ((s["plain_sum"] - s["flipped_sum"]) / float(n))
        return struct(mean2 * (float(n) - n_flipped) - s["plain_sum"],
                      mean2 * n_flipped + s["flipped_sum"],
                      mean2 - s["plain_shift"], mean2 + s["flipped_shift"])

    zero = F.lit(0.0)
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), struct(plain, flipped, zero, zero), step)


def iterate_reflect(v: CooTable, steps: int, flipped: DataFrame | None = None) -> CooTable:
    """``steps`` mean reflections of ``v``, the rows listed in ``flipped`` negated before each.

    ``flipped`` is a table of any size with a column ``row``; repeats and rows that ``v``
    lacks as entries are allowed, an index outside raises. Real and imaginary parts are both
    transformed. The result has all ``N`` rows. ``v`` is read twice, once for its sums and
    once for its rows: store an expensive one first.
    """
    n, steps = v.dims[0], int(steps)
    if steps < 1:
        raise ValueError(f"steps must be at least 1, got {steps}")
    dense = densify(v).df
    if flipped is None:
        rows = dense.withColumn("_flip", F.lit(False))
    else:
        marks = within(flipped.select(F.col("row").cast("bigint")).distinct(), ("row",), (n,)).select(
            present("row").alias("row"))
        rows = dense.join(marks.withColumn("_flip", F.lit(True)), "row", "left").withColumn(
            "_flip", F.coalesce("_flip", F.lit(False)))

    def total(part: str, on_flipped: bool) -> Column:
        picked = F.col("_flip") if on_flipped else ~F.col("_flip")
        return F.coalesce(F.sum(F.when(picked, F.col(part)).otherwise(0.0)), F.lit(0.0))

    sums = rows.agg(F.sum(F.col("_flip").cast("double")).alias("k"), *(
        total(part, on).alias(f"{part}_{int(on)}") for part in v.values for on in (False, True)))
    shifts = sums.select(F.struct(*(
        _shifts(F.col(f"{part}_0"), F.col(f"{part}_1"), n, F.col("k"), steps).alias(part)
        for part in v.values)).alias("shifts")).scalar()
    sign = -1.0 if steps % 2 else 1.0

    def moved(part: str) -> Column:
        x, shift = F.col(part), F.col("_shifts")[part]
        return F.when(F.col("_flip"), shift["flipped_shift"] + x).otherwise(
            shift["plain_shift"] + F.lit(sign) * x).alias(part)

    df = rows.withColumn("_shifts", shifts)
    return CooTable(df.select("row", "col", *(moved(p) for p in v.values)), v.dims, full=True)


def reflect(v: CooTable, flipped: DataFrame | None = None) -> CooTable:
    """One mean reflection of ``v``."""
    return iterate_reflect(v, 1, flipped)

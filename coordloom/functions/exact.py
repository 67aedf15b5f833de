"""Sums of doubles that do not depend on the order of the rows.

A double is cut into whole numbers of 24 bits, each told by its exponent. These are summed
as whole numbers, without any rounding, and put together once at the end, rounded once. So a
sum is the same to the last bit however the rows are dealt over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

_WIDTH = 24
_UNIT = 1 << _WIDTH
#: Numbers below 2^-900 are raised by five widths first, as their parts would be too small.
_TINY, _RAISED = 2.0 ** -900, 5
_PARTS = 4
# A sum of BIGINT parts reaches three widths above the highest.
_ABOVE = 3


def _power(exponent: Column) -> Column:
    """2 to a whole power, exact; in two steps, as the power itself may be too small."""
    return F.pow(F.lit(2.0), exponent)


def _cut(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(keys, _v, _x, _bin, _part): the parts of every value, ``_v`` the number of its column."""
    long = df.select(*keys, F.posexplode(F.array(*(F.col(v).cast("double") for v in values))).alias("_v", "_x"))
    finite = F.col("_x").isNotNull() & ~F.isnan("_x") & (F.abs("_x") < float("inf"))
    tiny = F.abs("_x") < _TINY
    rest = F.when(~finite, 0.0).when(tiny, F.col("_x") * 2.0 ** (_RAISED * _WIDTH)).otherwise(F.col("_x"))
    long = long.withColumns({"_rest": F.coalesce(rest, F.lit(0.0)),
                             "_low": F.when(finite & tiny, _RAISED).otherwise(0),
                             "_other": F.when(~finite, F.col("_x"))})
    top = F.when(F.col("_rest") == 0, 0).otherwise(F.floor(F.log2(F.abs("_rest")) / _WIDTH)).cast("int")
    long = long.withColumn("_top", top).withColumn("_scale", _power(F.col("_top") * _WIDTH))
    for k in range(_PARTS):
        long = long.withColumn(f"_p{k}", (F.col("_rest") / F.col("_scale")).cast("bigint"))
        long = long.withColumns({"_rest": F.col("_rest") - F.col(f"_p{k}") * F.col("_scale"),
                                 "_scale": F.col("_scale") / _UNIT})
    parts = F.filter(F.array(*(F.struct(
        (F.col("_top") - F.col("_low") - k).alias("bin"), F.col(f"_p{k}").alias("part")) for k in range(_PARTS))),
        lambda p: p["part"] != 0)
    return long.select(*keys, "_v", F.col("_x").isNotNull().cast("int").alias("_some"), "_other",
                       F.explode_outer(parts).alias("_p"))


def _digits(sums: Column, sign: int) -> Column:
    """Digits below 2^24 of ``sign`` times the sum, the lowest first, and what is left above."""
    def step(state: Column, part: Column) -> Column:
        total = state["carry"] + part * sign
        digit = F.pmod(total, F.lit(_UNIT).cast("bigint"))
        return F.struct(F.call_function("div", total - digit, F.lit(_UNIT).cast("bigint")).alias("carry"),
                        F.concat(state["digits"], F.array(digit)).alias("digits"))

    none = F.array().cast("array<bigint>")
    return F.aggregate(sums, F.struct(F.lit(0).cast("bigint").alias("carry"), none.alias("digits")), step)


def _rounded(digits: Column, low: Column) -> Column:
    """The double next to the number of these digits; ``low`` is the bin of the first one."""
    top = F.greatest(F.array_position(F.transform(F.reverse(digits), lambda d: d != 0), True), F.lit(1))
    at = F.size(digits) - top.cast("int") + 1  # the highest digit that is not zero, from 1
    a = F.element_at(digits, at) * _UNIT + F.element_at(digits, at - 1)
    below = F.exists(F.slice(digits, F.lit(1), F.greatest(at - 4, F.lit(0))), lambda d: d != 0)
    b = F.element_at(digits, at - 2) * _UNIT + F.element_at(digits, at - 3)
    # What lies further below only tells on which side of a tie the number is.
    b = b.bitwiseOR(below.cast("bigint"))
    exponent = (low + at - 4) * _WIDTH
    half = F.floor(exponent / 2).cast("int")
    return (a.cast("double") * 2.0 ** 48 + b.cast("double")) * _power(half) * _power(exponent - half)


def exact_sums(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``keys`` and the sum of each of ``values``, rounded once from the exact sum.

    NULLs are left out, a group of NULLs alone has NULL, infinities and NaN give what they do
    in a sum. Partial sums form in the tasks: a group has a row for each 24 bits that its
    values span. Up to 2^38 rows of one group fit; more raise.
    """
    parts = _cut(df, keys, values)
    sums = parts.groupBy(*keys, "_v", F.col("_p.bin").alias("_bin")).agg(
        F.sum("_p.part").alias("_part"), F.max("_some").alias("_some"), F.sum("_other").alias("_other"))
    grouped = sums.groupBy(*keys, "_v").agg(
        F.map_from_entries(F.collect_list(F.when(
            F.col("_bin").isNotNull(), F.struct("_bin", "_part")))).alias("_of"),
        F.min("_bin").alias("_low"), F.max("_bin").alias("_high"),
        F.max("_some").alias("_some"), F.sum("_other").alias("_other"))
    low = F.col("_low") - (_PARTS - 1)
    dense = F.transform(F.sequence(low, F.col("_high") + _ABOVE), lambda b: F.coalesce(
        F.try_element_at(F.col("_of"), b), F.lit(0).cast("bigint")))
    signed = grouped.withColumn("_dense", dense).withColumn("_plus", _digits(F.col("_dense"), 1)).withColumn(
        "_down", F.col("_plus.carry") < 0).withColumn("_digits", F.when(
            F.col("_down"), _digits(F.col("_dense"), -1)["digits"]).otherwise(F.col("_plus.digits")))
    total = _rounded(F.col("_digits"), low) * F.when(F.col("_down"), -1.0).otherwise(1.0)
    result = F.when(F.col("_some") == 1, F.coalesce("_other", total, F.lit(0.0)))
    each = signed.select(*keys, "_v", result.alias("_total"))
    return each.groupBy(*keys).agg(*(
        F.max(F.when(F.col("_v") == k, F.col("_total"))).alias(v) for k, v in enumerate(values)))

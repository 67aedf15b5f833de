"""A blocked Bloom filter as a small table, of bounded size whatever it was filled with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most 64-bit blocks of a filter: 16 MB when broadcast with their numbers.
MOST_BLOCKS = 1 << 20
_KEYS_PER_BLOCK = 4
_BITS = 5


def blocks_for(n: int) -> int:
    """Blocks for so many keys, within the bound."""
    return min(MOST_BLOCKS, n // _KEYS_PER_BLOCK + 1)


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def mask_of(key: Column) -> Column:
    """A few bits of one 64-bit block."""
    mixed = F.xxhash64(key, F.lit("bits"))
    mask = F.lit(0).cast("long")
    for k in range(_BITS):
        place = F.shiftrightunsigned(mixed, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return mask


def filled(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """Rows (``block``, ``bits``): the blocks that are not empty, at most ``blocks``."""
    return keys.groupBy(block_of(F.col(key), blocks).alias("block")).agg(
        F.bit_or(mask_of(F.col(key))).alias("bits"))


def sifted(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """Rows of ``df`` whose key may be among the wanted ones; none that is, is lost.

    Fewer rows then go on to an exact join. Only the filter is broadcast. Beyond some four
    million wanted keys it lets more and more of the others pass.
    """
    blocks = blocks_for(wanted.count())
    sieve = filled(wanted, wanted_key, blocks)
    mask = mask_of(F.col(key))
    return df.withColumn("block", block_of(F.col(key), blocks)).join(
        F.broadcast(sieve.withColumnRenamed("block", "of_block")),
        (F.col("block") == F.col("of_block")) & (F.col("bits").bitwiseAND(mask) == mask),
        "left_semi").drop("block")


def without(df: DataFrame, key: str, others: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is not in ``others``, a table of keys of the same name that are
    not null. Only rows whose key may be there move."""
    blocks = blocks_for(others.count())
    mask = mask_of(F.col(key))
    parted = df.withColumn("block", block_of(F.col(key), blocks)).join(
        F.broadcast(filled(others, key, blocks)), "block", "left").withColumn(
        "maybe", F.coalesce(F.col("bits").bitwiseAND(mask) == mask, F.lit(False)))
    moved = parted.filter("maybe").join(others, key, "left_anti")
    return parted.filter("not maybe").unionByName(moved).drop("block", "bits", "maybe")

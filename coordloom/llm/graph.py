"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coordloom.session import cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges with ``a > b``.

    Large: the larger neighbours of each node are tied to the smallest of its
    neighbourhood. Small: the smaller neighbours and the node itself are.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        tied = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        tied = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        tied = tied.unionByName(least.select("a", F.col("m").alias("b")))
    return tied.filter("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``node``, ``component``) for every node of an edge table of longs.

    The component is its smallest node. Every step groups with partial minima and joins
    on the node, so a node with very many neighbours is split by Spark like any skewed
    join; nothing is collected but the sums that tell whether a step changed anything.
    Edges with a null and loops are left out; an empty table gives no rows.
    """
    x, y = F.col(a), F.col(b)
    now = cut(edges.filter(x != y).select(
        F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct())

    def seen(df: DataFrame):
        row = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    before = seen(now)
    while before[0]:
        now = cut(_stars(_stars(now, large=True), large=False))
        after = seen(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

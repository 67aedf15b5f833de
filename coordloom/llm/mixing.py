"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

Each source is to have a share of all words in proportion to its weight. One that would
have to be repeated more often than allowed is clamped at that, and what it leaves over is
shared anew by weight, until no source is above. A source's whole repetitions are then taken
of all its documents, and a fraction of one more of those that come first by a seeded hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coordloom.session import cut

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = "mix"
#: Places of a document in the order of its source have 60 bits, looked at in these steps: a
#: source has at most 2^10 sums in each of the first two, few documents in the last ones.
_BITS, _SHIFTS = 60, (50, 40, 20, 0)
_NEW = ("size", "source_size", "target", "repeats", "taken")


def words_in(text: Column) -> Column:
    """Number of words of a text; null and empty ones have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df``, stored, with the number of every row in the order, from 0.

    Ranges of rows are sorted apart; one row for each range tells where it begins.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({
        "_range": F.spark_partition_id(),
        "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    held = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = held.select(F.col("_range").alias("_of"), (
        F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), F.col("_range") == F.col("_of")).withColumn(
        name, F.col("_before") + F.col("_at")).drop("_range", "_of", "_at", "_before")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) of every source of a table (source, size).

    Sources in the order of their code points, null last, have the weights in turn. The
    targets of all sources add up to all sizes; none is above ``epochs`` times its source's
    size. Each round is one sum over the sources, of which there may be any number: only the
    words and weights left for those below their limit are known to the driver.
    """
    if epochs < 1 or not weights or min(weights) < 1:
        raise ValueError("epochs and weights must be at least 1")
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = cut(_numbered(sums, [F.col("source").asc_nulls_last()], "k").select(
        "source", "source_size",
        F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int")).alias("weight")))
    exact = "decimal(38,0)"
    limit = F.col("source_size") * epochs

    def clamped(words: int, parts: int) -> Column:
        return F.lit(words).cast(exact) * F.col("weight") >= limit.cast(exact) * F.lit(parts)

    def sums_of(rows: DataFrame) -> tuple[int, int]:
        row = rows.agg(F.sum("source_size"), F.sum("weight").cast("long")).first()
        return row[0] or 0, row[1] or 0

    total, parts = sums_of(ranked)
    left = total, parts
    while True:
        # A source above its limit once stays above: the share of a weight only rises.
        full, gone = sums_of(ranked.filter(clamped(*left)))
        now = total - epochs * full, parts - gone
        if now == left:
            break
        left = now
    share = F.lit(float(left[0])) * F.col("weight") / F.lit(max(left[1], 1))
    return ranked.select("source", "source_size", F.when(
        clamped(*left), limit.cast("double")).otherwise(share).alias("target"))


def _same_source(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _edges(places: DataFrame, plans: DataFrame) -> DataFrame:
    """(of, edge, copies, some): where in the order of a source the fraction ends.

    Documents (source, place, size) before ``edge`` are taken once more, and ``some`` of the
    ``copies`` at it. Sums of sizes by leading bits of the place find it; no source is sorted.
    """
    at = plans.filter("want > 0").select(F.col("source").alias("of"), "want", F.lit(0).cast("long").alias("bin"))
    seen = _BITS
    for shift in _SHIFTS:
        within = places.join(at, _same_source("source", "of") & (
            F.shiftright("place", seen) == F.col("bin"))).groupBy(
            "of", "want", F.shiftright("place", shift).alias("part")).agg(
            F.sum("size").alias("words"), F.count("*").alias("copies"))
        up_to = F.sum("words").over(Window.partitionBy("of").orderBy("part"))
        at = cut(within.withColumn("before", up_to - F.col("words")).filter(
            (F.col("before") <= F.col("want")) & (F.col("want") < F.col("before") + F.col("words"))).select(
            "of", F.col("part").alias("bin"), (F.col("want") - F.col("before")).alias("want"), "words", "copies"))
        seen = shift
        places = places.select("source", "place", "size")
    some = F.round(F.col("want") * F.col("copies") / F.col("words")).cast("long")
    return at.select("of", F.col("bin").alias("edge"), "copies", some.alias("some"))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED,
          key: str = "doc_id", source: str = "source", size: Column | None = None) -> DataFrame:
    """``docs`` with ``size``, its ``source_size`` and ``target``, ``repeats`` and ``taken``.

    ``size`` is the number of words of ``text`` unless another column of whole numbers is
    given; ``repeats`` says how often the mix takes the document, ``taken`` how many words that
    is. Of every source whole repetitions of all documents are taken, and one more of the
    documents first in the order of a hash of ``seed``, ``key`` and size, as many as come
    nearest the target: the words taken differ from it by half a document at most. The same
    rows give the same mix, however they are stored.

    A null or empty text has size 0 and may be repeated, with no words. A null source is a
    source, the last. Repeated rows count each; as nothing tells them apart, any of them are
    those taken once more, the right number of them. An empty table gives no rows; columns
    with the new names are replaced. Documents are read twice: give a stored table whose
    ``size`` is a column if counting is dear.
    """
    names = [c for c in docs.columns if c not in _NEW]
    size = words_in(F.col("text")) if size is None else F.coalesce(size.cast("long"), F.lit(0))
    named = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("key").cast("string"), F.lit("null")), "size")
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in names)).alias("own"), F.col(f"`{key}`").alias("key"),
        F.col(f"`{source}`").alias("source"), size.alias("size")).select(
        "own", "source", "size", F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long").alias("place"))
    places = cut(rows.select("source", "place", "size"))
    aims = targets(places, weights, epochs)
    whole = F.coalesce(F.floor(F.try_divide("target", F.col("source_size").cast("double"))), F.lit(0))
    want = F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    # What rounds up to a whole repetition is one.
    more = F.col("want") >= F.greatest("source_size", F.lit(1))
    plans = cut(aims.withColumn("whole", whole).withColumn("want", want).select(
        "source", "source_size", "target", (F.col("whole") + more.cast("long")).alias("whole"),
        F.when(more, 0).otherwise(F.col("want")).alias("want")))
    edges = cut(_edges(places, plans))
    planned = cut(plans.join(edges, _same_source("source", "of"), "left").select(
        F.col("source").alias("of"), "source_size", "target", "whole", "edge", "copies", "some"))
    placed = rows.join(planned, _same_source("source", "of"))

    def taken(df: DataFrame, again: Column) -> DataFrame:
        repeats = F.col("whole") + F.coalesce(again, F.lit(False)).cast("long")
        return df.withColumn("repeats", repeats).select(
            "own.*", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))

    if planned.filter("copies > 1").isEmpty():
        return taken(placed, (F.col("place") < F.col("edge"))
                     | (F.col("place") == F.col("edge")) & (F.col("some") > 0))
    # Many rows at one edge are numbered, in parts that no source fills alone.
    level = F.coalesce((F.col("place") == F.col("edge")) & (F.col("copies") > 1), F.lit(False))
    before = (F.col("place") < F.col("edge")) | (
        F.col("place") == F.col("edge")) & (F.col("copies") == 1) & (F.col("some") > 0)
    tied = _numbered(placed.filter(level).withColumn("spread", F.xxhash64(F.monotonically_increasing_id())),
                     [F.col("of").asc_nulls_last(), F.col("spread")], "number")
    first = tied.groupBy(F.col("of").alias("whose")).agg(F.min("number").alias("first"))
    tied = tied.join(first, _same_source("of", "whose"))
    return taken(placed.filter(~level), before).unionByName(
        taken(tied, F.col("number") - F.col("first") < F.col("some")))


def repeated(mix: DataFrame) -> DataFrame:
    """Every row of a mix as often as it is taken, ``repetition`` counted from 0."""
    return mix.filter("repeats > 0").withColumn(
        "repetition", F.explode(F.sequence(F.lit(0).cast("long"), F.col("repeats") - 1)))

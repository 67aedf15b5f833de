"""In which order to multiply a chain: sizes by minimum sketches, cost by dynamic programming.

Every column of the last matrix draws random numbers. The smallest of those that a row
reaches through the chain tell how many columns it reaches, that is how many entries the
row has in the product, whichever order forms it. One pass per matrix carries the minima
of all sub-chains that end further right; a second one does the same for columns from the
left. The pairs that a product would form are then sums over one index of entries on the
left times entries on the right. Minima are kept as one of four levels an octave, eight to a
word, so that a sketch is 32 bytes wherever it moves.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from coordloom.operators.joins import TASK_ENTRIES, blocks, dealt
from coordloom.session import cut, scratch
from coordloom.table import HOT_ENTRIES, CooTable

#: Random numbers of a sketch; the relative error of one row is about 1 / sqrt(RANKS - 2).
RANKS = 32
#: Chains whose shapes allow no more pairs than this are ordered by shape, without a job.
SMALL = 1 << 22

#: Levels of a kept number for each octave: a level is a fifth wide, a sketch has an error of 18 %.
STEPS = 4

_SPACE = 1 << 62
_PACKED = 8
Order = int | tuple  # the number of an operator, or a pair of orders


def _words(ranks: int) -> list[str]:
    return [f"m{k}" for k in range(-(-ranks // _PACKED))]


def _level(number: Column) -> Column:
    """A number below 2^62 as one of 256 levels, the smallest number as the highest."""
    octaves = F.lit(62.0) - F.log2(number.cast("double") + 1)
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(octaves * STEPS))).cast("bigint")


def _packed(levels: Sequence[Column]) -> list[Column]:
    """Levels as words of eight bytes each."""
    shifted = [F.shiftleft(level, 8 * (k % _PACKED)) for k, level in enumerate(levels)]
    return [reduce(Column.bitwiseOR, shifted[k:k + _PACKED]).alias(m)
            for k, m in zip(range(0, len(shifted), _PACKED), _words(len(shifted)))]


def _unpacked(ranks: int) -> list[Column]:
    words = _words(ranks)
    return [F.shiftrightunsigned(words[k // _PACKED], 8 * (k % _PACKED)).bitwiseAND(F.lit(255).cast("bigint"))
            for k in range(ranks)]


def _drawn(index: str, ranks: int) -> list[Column]:
    """Random whole numbers below 2^62 of an index."""
    return [F.xxhash64(F.col(index), F.lit(k)).bitwiseAND(F.lit(_SPACE - 1)) for k in range(ranks)]


def _gathered(moved: DataFrame, keys: list[str], entries: int, heaviest: int, best: Callable[[Column], Column],
              numbers: Sequence[Column]) -> DataFrame:
    """The ``best`` of every number by ``keys``, as ``_n0 ..``, formed after the rows moved.

    Rows move with the index ``_draw`` that they draw from or with packed levels, as a task
    has too few of one index to reduce them there. An index of many rows is cut by ``_draw``.
    """
    cells = blocks(heaviest, HOT_ENTRIES)
    if cells > 1:
        moved = moved.withColumn("_cell", F.pmod(F.xxhash64("_draw"), F.lit(cells)))
    by = keys + ["_cell"] * (cells > 1)
    found = dealt(moved, blocks(entries, TASK_ENTRIES), *by).groupBy(*by).agg(
        *(best(x).alias(f"_n{k}") for k, x in enumerate(numbers)))
    if cells > 1:
        found = found.groupBy(*keys).agg(*(best(F.col(f"_n{k}")).alias(f"_n{k}") for k in range(len(numbers))))
    return found


def _carried(op: CooTable, own: str, other: str, number: int, before: DataFrame | None,
             ranks: int, last: bool = False) -> DataFrame:
    """Minima (at, end, entries, m0 ..) of one matrix: ``own`` its index that stays, ``other`` the
    one that meets ``before``. A sub-chain is told by the number of its other end. Of the
    ``last`` matrix nothing is carried on, so that its own entries are only counted."""
    words = _words(ranks)
    seen = Observation()
    counts = cut(op.df.groupBy(F.col(own).alias("at")).agg(F.count(F.lit(1)).alias("entries")).observe(
        seen, F.sum("entries").alias("entries"), F.max("entries").alias("heaviest")))
    entries, heaviest = (int(seen.get.get(n) or 0) for n in ("entries", "heaviest"))
    end = F.lit(number).alias("end")
    if last:
        fresh = counts.select("at", end, "entries", *(F.lit(0).cast("bigint").alias(m) for m in words))
    else:
        drawn = _gathered(op.df.select(F.col(own).alias("at"), F.col(other).alias("_draw")), ["at"], entries, heaviest,
                          F.min, _drawn("_draw", ranks))
        levels = [_level(F.col(f"_n{k}")) for k in range(ranks)]
        fresh = drawn.join(counts, "at").select("at", end, "entries", *_packed(levels))
    if before is None:
        return cut(fresh)
    ends = len(before.select("end").distinct().collect())
    met = op.df.select(F.col(own).alias("at"), F.col(other).alias("_draw")).join(
        before.select(F.col("at").alias("_draw"), "end", *words), "_draw")
    joined = _gathered(met, ["at", "end"], entries * ends, heaviest, F.max, _unpacked(ranks))
    levels = [F.col(f"_n{k}") for k in range(ranks)]
    return cut(fresh.unionAll(joined.select("at", "end", F.lit(0).cast("bigint").alias("entries"), *_packed(levels))))


def _estimated(minima: DataFrame, number: int, ranks: int) -> DataFrame:
    """(number, end, at, entries): estimates, for the matrix itself the count."""
    # The middle of a level, as a share of the space.
    shares = (F.pow(F.lit(2.0), -(level + 0.5) / F.lit(float(STEPS))) for level in _unpacked(ranks))
    total = reduce(lambda a, b: a + b, (-F.log1p(-share) for share in shares))
    return minima.select(F.lit(number).alias("number"), "end", "at", F.when(
        F.col("end") == number, F.col("entries").cast("double")).otherwise((ranks - 1) / total).alias("entries"))


def estimates(ops: Sequence[CooTable], ranks: int = RANKS, inner: bool = False) -> tuple[DataFrame, DataFrame]:
    """Entries of every row and of every column of every sub-chain.

    ``(first, last, at, entries)`` twice: ``at`` is a row of the product of the operators
    ``first`` to ``last``, and in the second table a column. ``inner`` leaves out what no
    product meets: rows of sub-chains from the first operator on, columns of those to the last.
    """
    if ranks < 3:
        raise ValueError("a sketch takes at least 3 ranks")
    before, rows, columns = None, [], []
    for n in reversed(range(inner, len(ops))):
        before = _carried(ops[n], "row", "col", n, before, ranks, n == inner)
        rows.append(_estimated(before, n, ranks))
    before = None
    final = len(ops) - 1 - inner
    for n, op in enumerate(ops[:final + 1]):
        before = _carried(op, "col", "row", n, before, ranks, n == final)
        columns.append(_estimated(before, n, ranks))
    by_row = reduce(DataFrame.unionAll, rows).select(
        F.col("number").alias("first"), F.col("end").alias("last"), "at", "entries")
    by_column = reduce(DataFrame.unionAll, columns).select(
        F.col("end").alias("first"), F.col("number").alias("last"), "at", "entries")
    return by_row, by_column


def estimated_entries(ops: Sequence[CooTable], ranks: int = RANKS) -> dict[tuple[int, int], float]:
    """Estimated entries of the product of every sub-chain ``(first, last)``; runs jobs."""
    rows, _ = estimates([op.merged().store() for op in ops], ranks)
    return {(r["first"], r["last"]): r["n"] for r in
            rows.groupBy("first", "last").agg(F.sum("entries").alias("n")).collect()}


def _best(n: int, pairs: Callable[[int, int, int], float],
          entries: Callable[[int, int], float]) -> tuple[float, Order]:
    """The cheapest parenthesization: pairs formed, and entries of what is not the result."""
    best: dict[tuple[int, int], tuple[float, Order]] = {(k, k): (0.0, k) for k in range(n)}
    for span in range(1, n):
        for i in range(n - span):
            j = i + span
            kept = entries(i, j) if span < n - 1 else 0.0
            best[i, j] = min(
                ((best[i, k][0] + best[k + 1, j][0] + pairs(i, k, j) + kept, (best[i, k][1], best[k + 1, j][1]))
                 for k in range(i, j)), key=lambda found: found[0])
    return best[0, n - 1]


def cheapest_order(ops: Sequence[CooTable], ranks: int = RANKS, small: int = SMALL) -> Order:
    """The order of products with the fewest pairs, as nested pairs of operator numbers.

    Where even the shapes allow few pairs they decide. Otherwise every operator is read
    twice for the sketches; what these store is deleted again.
    """
    n = len(ops)
    if n < 3:
        return 0 if n == 1 else (0, 1)
    sizes = [op.dims[0] for op in ops] + [ops[-1].dims[1]]
    by_shape = _best(n, lambda i, k, j: float(sizes[i] * sizes[k + 1] * sizes[j + 1]),
                     lambda i, j: float(sizes[i] * sizes[j + 1]))
    if by_shape[0] <= small:
        return by_shape[1]
    with scratch(ops[0].df.sparkSession) as noted:
        rows, columns = estimates([op.merged().store() for op in ops], ranks, inner=True)
        met = columns.select(F.col("first").alias("i"), F.col("last").alias("k"), "at", F.col("entries").alias("c")).join(
            rows.select((F.col("first") - 1).alias("k"), F.col("last").alias("j"), "at", F.col("entries").alias("r")),
            ["k", "at"]).groupBy("i", "k", "j").agg(F.sum(F.col("c") * F.col("r")).alias("pairs"))
        pairs = {(r["i"], r["k"], r["j"]): r["pairs"] for r in met.collect()}
        both = rows.unionAll(columns.where(F.col("first") == 0))
        entries = {(r["first"], r["last"]): r["n"] for r in
                   both.groupBy("first", "last").agg(F.sum("entries").alias("n")).collect()}
    noted.release()
    return _best(n, lambda *at: pairs.get(at, 0.0), lambda *at: entries.get(at, 0.0))[1]

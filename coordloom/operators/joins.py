"""The one equi-join under every product, made safe for hot keys.

Three plans, the first that applies:

1. A side proven to fit the session's broadcast threshold is broadcast; the other
   side is not moved at all.
2. A side bucketed by the key joins in place; only the other side moves.
3. Otherwise both sides move by key. Unless the caller rules hot keys out, the
   keys with more than ``hot`` entries on a side, or more than ``PAIRS`` pairs, are
   looked up first and cut into a grid of cells that hold no more than these. A left
   entry belongs to one cell row and is repeated along it, a right entry to one cell
   column, so each pair meets exactly once. The list of such keys is a table like any
   other, of whatever length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from coordloom.session import broadcast_entries, cut
from coordloom.table import HOT_ENTRIES

# Pairs of one key that a single cell may form.
PAIRS = 1 << 26
# Pairs that a task forms on average: the sums it forms of them stay in memory.
TASK_PAIRS = 1 << 22
# Entries that a task sorts on average.
TASK_ENTRIES = 1 << 21
# Entries of a key whose pairs with each other are formed from one list.
LISTED = 1 << 10
# Of the number of columns whose sums move in one list.
SPAN_BITS = 12


def fits_broadcast(df: DataFrame, bound: int | None) -> bool:
    return bound is not None and bound <= broadcast_entries(df.sparkSession)


def smaller_fitting(sides: tuple[DataFrame, DataFrame],
                    bounds: Sequence[int | None]) -> int | None:
    """Position of the side to broadcast: of those that fit, the smaller one."""
    fitting = [n for n in (0, 1) if fits_broadcast(sides[n], bounds[n])]
    return min(fitting, key=lambda n: bounds[n], default=None)


def hot_keys(left: DataFrame, right: DataFrame, key: str, hot: int, pairs: int,
             seen: Observation | None = None) -> DataFrame:
    """Cells of every hot key: ``key, _cells_l, _cells_r``.

    Counts are formed before the shuffle, so a hot key costs one row per task. ``seen`` takes
    the ``entries`` and ``pairs`` of all keys as the table is written.
    """
    one, zero = F.lit(1), F.lit(0)
    counts = (
        left.select(key, one.alias("_l"), zero.alias("_r"))
        .unionAll(right.select(key, zero.alias("_l"), one.alias("_r")))
        .groupBy(key)
        .agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    )
    if seen is not None:
        counts = counts.observe(seen, F.sum(F.col("_l") + F.col("_r")).alias("entries"),
                                F.sum(F.col("_l").cast("double") * F.col("_r")).alias("pairs"))
    counts = counts.where(((F.col("_l") > hot) | (F.col("_r") > hot) | (F.col("_l").cast("double") * F.col("_r") > pairs))
                          & (F.col("_l") > 0) & (F.col("_r") > 0))
    # The smaller side keeps its entries together as far as the pairs allow.
    side = F.least(F.lit(hot), F.greatest("_l", "_r"))
    less = F.least(F.lit(hot), F.least("_l", "_r"), F.lit(max(1, int(pairs ** 0.5))))
    more = F.greatest(F.lit(1), F.least(side, F.floor(F.lit(pairs) / less)))
    per_l = F.when(F.col("_l") <= F.col("_r"), less).otherwise(more)
    per_r = F.when(F.col("_l") <= F.col("_r"), more).otherwise(less)
    return counts.select(key, F.ceil(F.col("_l") / per_l).cast("int").alias("_cells_l"),
                         F.ceil(F.col("_r") / per_r).cast("int").alias("_cells_r"))


def _placed(df: DataFrame, hot: DataFrame, key: str, spread: tuple[str, ...], own: str,
            other: str) -> DataFrame:
    """``df`` with its cell numbers; its own by hash, the other side's by repeat."""
    own_cells, other_cells = (F.coalesce(f"_cells_{s}", F.lit(1)) for s in (own, other))
    return (
        df.join(hot, key, "left")
        .withColumn(f"_cell_{own}", F.pmod(F.xxhash64(*spread), own_cells).cast("int"))
        .withColumn(f"_cell_{other}",
                    F.explode(F.sequence(F.lit(0), other_cells - F.lit(1))))
        .drop("_cells_l", "_cells_r")
    )


def cells_join(left: DataFrame, right: DataFrame, key: str,
               spread: tuple[tuple[str, ...], tuple[str, ...]], found: DataFrame, tasks: int = 1) -> DataFrame:
    """Inner join in which every key of ``found`` is cut into its cells, over ``tasks`` tasks.

    Stored before, ``found`` has a true size, by which Spark picks its join.
    """
    return _dealt_join(_placed(left, found, key, spread[0], "l", "r"), _placed(right, found, key, spread[1], "r", "l"),
                       [key, "_cell_l", "_cell_r"], tasks).drop("_cell_l", "_cell_r")


def _dealt_join(left: DataFrame, right: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """Inner join over at least ``tasks`` tasks, for which one leaves the deal to Spark."""
    if tasks > 1:
        left, right = (dealt(side, tasks, *keys) for side in (left, right))
    return left.join(right, keys)


def keyed_join(left: DataFrame, right: DataFrame, key: str, *,
               spread: tuple[tuple[str, ...], tuple[str, ...]],
               bounds: tuple[int | None, int | None],
               hot: int | None = HOT_ENTRIES, pairs: int = PAIRS) -> DataFrame:
    """Inner join on ``key``. ``spread`` names the columns that tell the entries
    of one key apart on either side, ``bounds`` the proven sizes. ``hot=None``
    looks for no hot keys: there are none, or a side is bucketed by the key. Where they are
    looked for, entries and pairs are known, and set the number of tasks."""
    small = smaller_fitting((left, right), bounds)
    if small == 1:
        return left.join(F.broadcast(right), key)
    if small == 0:
        return F.broadcast(left).join(right, key)
    if hot is None:
        return left.join(right, key)
    seen = Observation()
    found = cut(hot_keys(left, right, key, hot, pairs, seen))
    total = {n: int(seen.get.get(n) or 0) for n in ("entries", "pairs")}
    tasks = max(blocks(total["entries"], TASK_ENTRIES), blocks(total["pairs"], TASK_PAIRS))
    if found.isEmpty():
        return _dealt_join(left, right, [key], tasks)
    return cells_join(left, right, key, spread, found, tasks)


def _own_parts(df: DataFrame, key: str, own: str, value: str, hot: int, listed: int,
               task: int) -> tuple[DataFrame, DataFrame | None, int]:
    """Pairs of the keys of short lists, with ``_r``, the range of keys that a task holds; those of
    long lists, if there are any; the number of tasks that the pairs ask for."""
    seen = Observation()
    n = F.col("_n").cast("double")
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).observe(
        seen, F.sum(n * (n + 1) / 2).alias("pairs"), F.count(F.lit(1)).alias("keys"))
    long = cut(counts.where(F.col("_n") > min(hot, listed)).select(key))
    tasks = blocks(int(seen.get.get("pairs") or 0), task)
    width = blocks(seen.get.get("keys") or 0, tasks)
    columns = [F.col(own).alias("_i"), F.col(value).alias("_a")]
    others = [F.col(own).alias("_j"), F.col(value).alias("_b")]
    joined = None
    if not long.isEmpty():
        heavy = df.join(long, key, "left_semi")
        joined = keyed_join(heavy.select(key, *columns), heavy.select(key, *others), key, spread=(("_i",), ("_j",)),
                            bounds=(None, None), hot=hot).where(F.col("_i") <= F.col("_j")).select("_i", "_a", "_j", "_b")
        df = df.join(long, key, "left_anti")
    ranges = df.withColumn("_r", (F.floor(F.col(key) / width) % tasks).cast("int")).repartitionById(tasks, "_r")
    lists = ranges.groupBy("_r", key).agg(F.collect_list(F.struct(*columns)).alias("_l"))
    pairs = lists.select("_r", F.explode("_l").alias("_x"), "_l").select("_r", "_x", F.explode("_l").alias("_y")).where(
        F.col("_x._i") <= F.col("_y._i")).select(
        "_r", "_x._i", "_x._a", F.col("_y._i").alias("_j"), F.col("_y._a").alias("_b"))
    return pairs, joined, tasks


def own_pairs(df: DataFrame, key: str, own: str, value: str, hot: int = HOT_ENTRIES,
              listed: int = LISTED, task: int = TASK_PAIRS) -> DataFrame:
    """Entries of one key paired with each other and themselves: ``_i, _a, _j, _b`` with ``_i <= _j``.

    The entries move once, by ranges of as many keys each, and every key pairs its list in place.
    Keys of more than ``listed`` entries are joined, the hot ones in cells. ``df`` is read three times.
    """
    pairs, joined, _ = _own_parts(df, key, own, value, hot, listed, task)
    pairs = pairs.select("_i", "_a", "_j", "_b")
    return pairs if joined is None else pairs.unionAll(joined)


def _held_as(kind: str) -> Column:
    """The sums of a list as numbers of this kind, NULL if it does not hold all of them."""
    whole = F.forall("_s", lambda x: F.coalesce(x.try_cast(kind).cast("double") == x, F.lit(False)))
    return F.when(whole, F.col("_s").cast(f"array<{kind}>"))


def own_sums(df: DataFrame, key: str, own: str, value: str, hot: int = HOT_ENTRIES,
             listed: int = LISTED, task: int = TASK_PAIRS) -> DataFrame:
    """``row, col, re``: products of the pairs of :func:`own_pairs`, summed by ``_i`` and ``_j``.

    A task sums its pairs before they move, and sums move as lists: those of a row and of
    ``1 << SPAN_BITS`` neighbouring columns in one row, by their short offsets and in the narrowest kind
    of number that holds them all. What neighbouring keys share is one sum then; where they
    share nothing, a pair moves as some four bytes.
    """
    pairs, joined, tasks = _own_parts(df, key, own, value, hot, listed, task)
    product = (F.col("_a") * F.col("_b")).alias("_s")
    place = [F.shiftright("_j", SPAN_BITS).alias("_c"),
             F.col("_j").bitwiseAND(F.lit((1 << SPAN_BITS) - 1)).cast("smallint").alias("_o")]
    sums = pairs.select("_r", "_i", *place, product).groupBy("_r", "_i", "_c", "_o").agg(F.sum("_s").alias("_s"))
    lists = sums.groupBy("_r", "_i", "_c").agg(F.collect_list("_o").alias("_o"), F.collect_list("_s").alias("_s")).drop("_r")
    if joined is not None:
        more = joined.select("_i", "_j", product).groupBy("_i", "_j").agg(F.sum("_s").alias("_s")).select("_i", *place, "_s")
        lists = lists.unionByName(more.select("_i", "_c", F.array("_o").alias("_o"), F.array("_s").alias("_s")))
    narrow = lists.withColumn("_t", _held_as("tinyint")).withColumn(
        "_u", F.when(F.col("_t").isNull(), _held_as("smallint"))).withColumn(
        "_s", F.when(F.col("_t").isNull() & F.col("_u").isNull(), F.col("_s")))
    moved = dealt(narrow, tasks, "_i", "_c")
    each = moved.select("_i", "_c", F.explode(F.arrays_zip("_o", F.coalesce(
        F.col("_t").cast("array<double>"), F.col("_u").cast("array<double>"), "_s").alias("_s"))).alias("_x"))
    return each.select("_i", "_c", "_x._o", "_x._s").groupBy("_i", "_c", "_o").agg(F.sum("_s").alias("re")).select(
        F.col("_i").alias("row"), (F.shiftleft("_c", SPAN_BITS) + F.col("_o")).alias("col"), "re")


def blocks(entries: int, per_block: int) -> int:
    return max(1, -(-entries // per_block))


def dealt(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """``df`` by its keys over ``tasks`` partitions, which adaptive execution, that knows bytes
    and no pairs, does not put together; data for one task is left to it."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(tasks, least), *keys) if tasks > 1 else df.repartition(*keys)


def block_pairing(left: DataFrame, right: DataFrame, *, left_id: list[str],
                  right_id: list[str], left_blocks: int, right_blocks: int,
                  small: int | None) -> DataFrame:
    """Each left entry with each right entry, as an equi-join on block numbers.

    Either side is dealt into blocks by hash and repeated over the blocks of the
    other side, so a task pairs one left block with one right block. With a side
    small enough to broadcast (``small``) nothing is shuffled.
    """
    def dealt(df: DataFrame, ids: list[str], own: str, n: int, other: str, m: int) -> DataFrame:
        own_block: Column = F.pmod(F.xxhash64(*ids), F.lit(n)).cast("int")
        return df.withColumn(f"_block_{own}", own_block).withColumn(
            f"_block_{other}", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    a = dealt(left, left_id, "l", left_blocks, "r", right_blocks)
    b = dealt(right, right_id, "r", right_blocks, "l", left_blocks)
    if small == 0:
        a = F.broadcast(a)
    elif small == 1:
        b = F.broadcast(b)
    return a.join(b, ["_block_l", "_block_r"]).drop("_block_l", "_block_r")

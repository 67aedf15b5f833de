"""Hard negatives by a secondary-sort shuffle.

Pair scores are packed into keys (anchor, descending score, id), dealt by anchor and sorted by
``repartitionAndSortWithinPartitions``. An iterator over the sorted keys opens a window of
scores for each positive it meets and emits the negatives that fall into open windows; it holds
the windows of one anchor and nothing else. Before the shuffle every task leaves out the pairs
that cannot be among the first, by what it has seen itself.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coordloom.session import cut

POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies within these hundredths of the positive's.
LOW, HIGH = 50, 95
#: Components are multiplied by this and rounded down.
SCALE = 256
#: Numbers of a block of anchors that a task holds, rows of a block that it reads past them,
#: and scores that it has at once.
ANCHOR_NUMBERS, BLOCK_ROWS, SCORES_AT_ONCE = 1 << 22, 1 << 13, 1 << 20
_FIRST_ROWS = 64
_POSITIVE, _NEGATIVE = 0, 1
#: Anchor, its fingerprint, falling score, kind, id: bytes in the order of sorting.
_KEY = struct.Struct(">QQQBQ")
_FIELDS = np.dtype([("anchor", ">u8"), ("mark", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
_SIGN = 1 << 63
_ROW = "dim int, a int, s int, kind int, id long, label long, mark long, q array<long>, wins array<long>"


def _unsigned(x: np.ndarray) -> np.ndarray:
    """Signed numbers as unsigned ones of the same order."""
    return x.astype(np.int64).view(np.uint64) ^ np.uint64(_SIGN)


def packed_keys(anchor: np.ndarray, mark: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> pa.Array:
    """Keys as binary values."""
    keys = np.empty(len(ids), _FIELDS)
    keys["anchor"], keys["mark"], keys["id"] = _unsigned(anchor), _unsigned(mark), _unsigned(ids)
    keys["score"], keys["kind"] = ~_unsigned(score), kind
    return pa.Array.from_buffers(pa.binary(_KEY.size), len(ids), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())


def unpacked(key: bytes) -> tuple[int, int, int, int, int]:
    """(anchor, mark, score, kind, id) of a key."""
    anchor, mark, score, kind, other = _KEY.unpack(key)
    return anchor - _SIGN, mark - _SIGN, (_SIGN * 2 - 1 - score) - _SIGN, kind, other - _SIGN


def opened(keys: Iterable[bytes], positives: int, negatives: int, low: int, high: int) -> Iterator[tuple]:
    """(anchor, positive, rank, negative, positive's score, negative's) from keys in order."""
    own, windows = None, []
    for key in keys:
        anchor, mark, score, kind, other = unpacked(key)
        if own != (anchor, mark):
            own, windows = (anchor, mark), []
        if kind == _POSITIVE:
            if len(windows) < positives:
                windows.append([other, score, 0])
            continue
        for window in windows:
            positive, best, found = window
            if found < negatives and low * best <= 100 * score <= high * best:
                window[2] += 1
                yield anchor, positive, found + 1, other, best, score


def first_positives(keys: Iterable[bytes], positives: int) -> Iterator[tuple]:
    """(anchor, mark, scores of its first positives) from keys in order."""
    own, scores = None, []
    for key in keys:
        anchor, mark, score, _, _ = unpacked(key)
        if own != (anchor, mark):
            if own is not None:
                yield *own, scores
            own, scores = (anchor, mark), []
        if len(scores) < positives:
            scores.append(score)
    if own is not None:
        yield *own, scores


def _sorted_through(pairs: DataFrame, work: Callable[[Iterator[bytes]], Iterator[tuple]], schema: T.StructType) -> DataFrame:
    """``work`` on the keys of every anchor, in their order, by a secondary-sort shuffle."""
    spark = pairs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = pairs.rdd.map(lambda row: (bytes(row[0]), None))
    in_order = keyed.repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:16]))
    return spark.createDataFrame(
        in_order.mapPartitions(lambda items: work(key for key, _ in items)), schema, verifySchema=False)


@dataclass
class _Best:
    """The first ``keep`` rows of every slot: (slot, score, id), falling scores, rising ids."""

    slots: int
    keep: int

    def __post_init__(self) -> None:
        self.slot = self.score = self.ids = np.zeros(0, np.int64)
        self.least = np.full(self.slots, np.iinfo(np.int64).min)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = (np.concatenate(x) for x in (
            (self.slot, slot), (self.score, score), (self.ids, ids)))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        last = place == self.keep - 1
        self.least[slot[last]] = score[last]
        top = place < self.keep
        self.slot, self.score, self.ids = slot[top], score[top], ids[top]


class _Cell:
    """A block of anchors, past which rows are streamed."""

    def __init__(self, parts: list[pa.RecordBatch], negatives: int | None, positives: int, low: int, high: int) -> None:
        table = pa.Table.from_batches(parts)
        self.ids, self.labels, self.marks = (table.column(c).to_numpy() for c in ("id", "label", "mark"))
        self.q = _matrix(table)
        self.windows = None
        if negatives is None:
            self.best = [_Best(len(self.ids), positives)]
            return
        # Windows as whole numbers; an anchor with fewer positives has empty ones.
        wins = np.zeros((len(self.ids), positives), np.int64)
        some = np.zeros((len(self.ids), positives), bool)
        for k, own in enumerate(table.column("wins").to_pylist()):
            wins[k, :len(own)], some[k, :len(own)] = own, True
        self.windows = [(np.where(s, -(-low * w // 100), 1), np.where(s, high * w // 100, 0))
                        for w, s in zip(wins.T, some.T)]
        self.best = [_Best(len(self.ids), negatives) for _ in range(positives)]

    def meet(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray) -> None:
        """Another few rows."""
        scores = _scores(self.q, q)
        fits = self.labels[:, None] == labels[None, :]
        if self.windows is None:
            fits &= self.ids[:, None] != ids[None, :]
            fits &= scores >= self.best[0].least[:, None]
            self._note(self.best[0], fits, scores, ids)
            return
        fits = ~fits
        for (low, high), best in zip(self.windows, self.best):
            near = scores >= np.maximum(low, best.least)[:, None]
            near &= scores <= high[:, None]
            near &= fits
            self._note(best, near, scores, ids)

    def _note(self, best: _Best, where: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        row, column = np.nonzero(where)
        if len(row):
            best.add(row, scores[row, column], ids[column])

    def keys(self) -> Iterator[pa.RecordBatch]:
        kind = _POSITIVE if self.windows is None else _NEGATIVE
        # A row in several windows goes on once.
        slot, score, ids = (np.concatenate([getattr(b, x) for b in self.best]) for x in ("slot", "score", "ids"))
        if len(self.best) > 1 and len(slot):
            repeat = np.concatenate([_occurrence(b) for b in self.best])
            found = np.unique(np.stack([slot, score, ids, repeat]), axis=1)
            slot, score, ids, _ = found
        yield pa.RecordBatch.from_arrays(
            [packed_keys(self.ids[slot], self.marks[slot], score, kind, ids)], ["key"])


def _occurrence(best: _Best) -> np.ndarray:
    """Of rows equal in slot, score and id, the number of each."""
    rows = np.stack([best.slot, best.score, best.ids])
    fresh = np.ones(len(best.slot), bool)
    fresh[1:] = (rows[:, 1:] != rows[:, :-1]).any(0)
    start = np.flatnonzero(fresh)
    return np.arange(len(fresh)) - np.repeat(start, np.diff(np.append(start, len(fresh))))


def _matrix(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    column = table.column("q")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as exact whole numbers."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    most = a.shape[1] * max(1, int(max(a.max(), -a.min(), 0))) * max(1, int(max(b.max(), -b.min(), 0)))
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= 1 << 62:
        raise ValueError("scores of such large components do not fit a long")
    return a @ b.T


def _pairs(anchors: DataFrame, rows: DataFrame, blocks: tuple[int, int], negatives: int | None,
           positives: int, low: int, high: int) -> DataFrame:
    """Keys of what may be among the first, cell by cell: a block of anchors met by a block of
    rows, which streams past. A cell gives at most ``positives * negatives`` keys an anchor."""
    by_anchor, by_row = (F.pmod(F.xxhash64("id", "mark"), F.lit(n)).cast("int") for n in blocks)
    left = anchors.select("dim", by_anchor.alias("a"), F.explode(F.sequence(F.lit(0), F.lit(blocks[1] - 1))).alias("s"),
                          F.lit(0).alias("kind"), "id", "label", "mark", "q", "wins")
    right = rows.select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks[0] - 1))).alias("a"), by_row.alias("s"),
                        F.lit(1).alias("kind"), "id", "label", "mark", "q", F.lit(None).cast("array<long>").alias("wins"))
    dealt = left.unionByName(right).repartition(blocks[0] * blocks[1], "dim", "a", "s").sortWithinPartitions(
        "dim", "a", "s", "kind")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, waiting, cell, seen = None, [], None, 0
        for batch in batches:
            at = np.stack([batch.column(c).to_numpy() for c in ("dim", "a", "s", "kind")])
            edges = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1
            for start, stop in zip([0, *edges], [*edges, batch.num_rows]):
                if start == stop:
                    continue
                part, place = batch.slice(start, stop - start), tuple(at[:3, start].tolist())
                if place != own:
                    if cell is not None:
                        yield from cell.keys()
                    own, waiting, cell, seen = place, [], None, 0
                if at[3, start] == 0:
                    waiting.append(part)
                    continue
                if cell is None:
                    if not waiting:
                        continue
                    cell = _Cell(waiting, negatives, positives, low, high)
                    waiting = []
                ids, labels, q = part.column("id").to_numpy(), part.column("label").to_numpy(), _matrix(part)
                first = 0
                while first < len(ids):  # the first rows lower what later ones have to be held for
                    n = min(max(_FIRST_ROWS, seen), max(1, SCORES_AT_ONCE // len(cell.ids)))
                    cell.meet(ids[first:first + n], labels[first:first + n], q[first:first + n])
                    first, seen = first + n, seen + n
        if cell is not None:
            yield from cell.keys()

    return dealt.select(*(f.split()[0] for f in _ROW.split(", "))).mapInArrow(met, "key binary")


def mined(rows: DataFrame, is_anchor: Column, key: str = "vec_id", label: Column | str = "label",
          vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES,
          low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become ``floor(scale * x)``; a score is an inner product of these, a whole
    number. An anchor's positives are its first ``positives`` rows of its label, by falling score
    and rising key; each gets the first ``negatives`` rows of other labels, in that order, whose
    score lies within ``low`` and ``high`` hundredths of its own.

    Rows with a null key, label or vector, or a null or non-finite component, take no part; zero
    vectors do, and vectors of different lengths have no score together. Rows equal in key, label
    and vector are one; other rows of one key are each a row, though none is a positive of an
    anchor of that key. An empty table gives no rows. Only the named columns are read. All rows
    meet all anchors, in cells of bounded size; scores that do not fit a long are an error.
    """
    if not 0 <= low <= high <= 100 or positives < 1 or negatives < 1:
        raise ValueError("low and high are hundredths in order, positives and negatives at least 1")
    labelled = F.col(f"`{label}`") if isinstance(label, str) else label
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    own = rows.select(
        F.col(f"`{key}`").cast("long").alias("id"), labelled.cast("long").alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks")).filter(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    whole = F.transform("vector", lambda v: F.floor(F.lit(float(scale)) * v))
    base = cut(own.groupBy("id", "label", whole.alias("q")).agg(F.max("asks").alias("asks")).withColumns({
        "dim": F.size("q"), "mark": F.xxhash64("label", "q"), "wins": F.lit(None).cast("array<long>")}))
    sizes = base.agg(F.count("*"), F.count_if("asks"), F.max("dim")).first()
    anchors = base.filter("asks")
    blocks = (max(1, -(-sizes[1] * max(sizes[2] or 1, 1) // ANCHOR_NUMBERS)), max(1, -(-sizes[0] // BLOCK_ROWS)))
    close = cut(_pairs(anchors, base, blocks, None, positives, low, high))
    long = T.LongType()
    wins = cut(_sorted_through(close, lambda keys: first_positives(keys, positives), T.StructType([
        T.StructField("of", long), T.StructField("of_mark", long), T.StructField("wins", T.ArrayType(long))])))
    windowed = anchors.drop("wins").join(wins, (F.col("id") == F.col("of")) & (F.col("mark") == F.col("of_mark")))
    far = _pairs(windowed, base, blocks, negatives, positives, low, high)
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return _sorted_through(
        cut(close.unionByName(far)), lambda keys: opened(keys, positives, negatives, low, high),
        T.StructType([T.StructField(n, T.IntegerType() if n == "rank" else long) for n in names]))

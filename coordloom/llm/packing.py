"""Best-fit packing of token pieces into sequences by bin completion.

A packing depends on lengths alone, and there are at most ``capacity`` of them. So the
lengths are counted on the cluster, patterns of lengths with multiplicities are searched
in the counts, whose size is bounded whatever the corpus, and every piece finds its place
from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coordloom.llm.token_ids import token_ids
from coordloom.session import cut

CAPACITY = 2048
END_OF_TEXT = 0
#: The most nodes of the search; the best packing found so far is always complete.
NODES = 4_000
#: Fillings tried at a node, and steps in looking for them.
FILLINGS, STEPS = 4, 2_000
_ROWS_AT_ONCE = 256
_RANK_BITS = 44

Patterns = list[tuple[tuple[int, ...], int]]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: by total length, and by pieces too long to share."""
    best = -(-sum(k * n for k, n in counts.items()) // capacity)
    for small in {0, *(k for k in counts if 2 * k <= capacity)}:
        alone = sum(n for k, n in counts.items() if k > capacity - small)
        halves = [(k, n) for k, n in counts.items() if capacity - small >= k > capacity / 2]
        filled = sum(k * n for k, n in counts.items() if capacity / 2 >= k >= small)
        room = sum(n * (capacity - k) for k, n in halves)
        best = max(best, alone + sum(n for _, n in halves) + max(0, -(-(filled - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Patterns:
    """Best fit decreasing, on groups of equal sequences."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    spaces: list[int] = []

    def put(pattern: tuple[int, ...], n: int) -> None:
        space = capacity - sum(pattern)
        if space not in groups:
            groups[space] = []
            insort(spaces, space)
        groups[space].append((pattern, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                each = capacity // length
                if left // each:
                    put((length,) * each, left // each)
                if left % each:
                    put((length,) * (left % each), 1)
                break
            space = spaces[at]
            pattern, n = groups[space].pop()
            used = min(n, left)
            if n > used:
                groups[space].append((pattern, n - used))
            if not groups[space]:
                del groups[space], spaces[at]
            put((*pattern, length), used)
            left -= used
    return [g for found in groups.values() for g in found]


def _dominated(b: tuple[int, ...], a: tuple[int, ...]) -> bool:
    """Whether the pieces of ``b`` fit into the pieces of ``a``, each as a small bin."""
    def fit(k: int, room: list[int]) -> bool:
        if k == len(b):
            return True
        for j in range(len(room)):
            if room[j] >= b[k] and room[j] not in room[:j]:
                room[j] -= b[k]
                if fit(k + 1, room):
                    return True
                room[j] += b[k]
        return False

    return a != b and sum(a) >= sum(b) and len(b) <= 8 and fit(0, list(a))


def fillings(lengths: list[int], counts: dict[int, int], room: int) -> list[tuple[int, ...]]:
    """Undominated ways to fill ``room``, least waste first, then fewest pieces.

    ``lengths`` are the lengths left, ascending. Only fillings to which no further piece can
    be added are made; long pieces are tried first.
    """
    found: dict[tuple[int, ...], int] = {}
    steps = 0
    stack: list[tuple[tuple[int, ...], int, int]] = [((), room, bisect_left(lengths, room + 1))]
    while stack and steps < STEPS:
        chosen, left, top = stack.pop()
        steps += 1
        top = min(top, bisect_left(lengths, left + 1))
        if left and top:
            exact = top - 1 if lengths[top - 1] == left else -1
            # The deepest choice on top of the stack: the longest piece that fits.
            low = max(0, top - 6) if len(chosen) > 1 else max(0, top - 400)
            options = [exact] if exact >= 0 and chosen.count(left) < counts[left] else [
                k for k in range(low, top) if chosen.count(lengths[k]) < counts[lengths[k]]]
            if not options:
                options = [k for k in range(low - 1, -1, -1)
                           if chosen.count(lengths[k]) < counts[lengths[k]]][:1]
            stack += [((*chosen, lengths[k]), left - lengths[k], k + 1) for k in options]
            if options:
                continue
        found[chosen] = left
        if not left and sum(not w for w in found.values()) >= 2 * FILLINGS:
            break
    ranked = sorted(found, key=lambda f: (found[f], len(f), tuple(-x for x in f)))
    kept: list[tuple[int, ...]] = []
    for f in ranked[:8 * FILLINGS]:
        if not any(_dominated(f, a) for a in kept):
            kept.append(f)
        if len(kept) == FILLINGS:
            break
    return kept or [()]


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> Patterns:
    """Patterns of lengths and how often each is used, in as few sequences as found.

    Branch and bound: the longest piece left is completed by an undominated filling, as
    many times as the counts allow; a branch ends when its waste exceeds what a packing
    better than the incumbent may waste. Best fit gives the first incumbent, and completes
    nodes to further ones. The search ends at the lower bound or after ``nodes`` nodes.
    """
    counts = {k: n for k, n in counts.items() if n}
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError(f"lengths must lie in 1 .. {capacity}")
    best = best_fit(counts, capacity)
    fewest, bound = sum(n for _, n in best), lower_bound(counts, capacity)
    total = sum(k * n for k, n in counts.items())
    left, lengths = dict(counts), sorted(counts)
    path: list[tuple[Counter, tuple[int, ...], int, list[tuple[int, ...]]]] = []
    used = waste = visited = 0

    def change(pieces: Counter, n: int) -> None:
        for k, each in pieces.items():
            left[k] += n * each
            at = bisect_left(lengths, k)
            present = at < len(lengths) and lengths[at] == k
            if left[k] and not present:
                lengths.insert(at, k)
            elif not left[k] and present:
                del lengths[at]

    options: list[tuple[int, ...]] | None = None
    while fewest > bound and visited < nodes:
        if options is None and lengths:
            visited += 1
            top = lengths[-1]
            left[top] -= 1
            options = [(top, *f) for f in fillings(lengths, left, capacity - top)]
            left[top] += 1
            if visited % 512 == 1:
                rest = best_fit({k: left[k] for k in lengths}, capacity)
                if used + sum(n for _, n in rest) < fewest:
                    best = [(p, n) for _, p, n, _ in path] + rest
                    fewest = sum(n for _, n in best)
        elif options is None:  # all pieces are placed
            if used < fewest:
                best, fewest = [(p, n) for _, p, n, _ in path], used
            options = []
        while not options and path:
            pieces, pattern, n, options = path.pop()
            change(pieces, n)
            used, waste = used - n, waste - n * (capacity - sum(pattern))
        if not options:
            break
        pattern, options = options[0], options[1:]
        pieces = Counter(pattern)
        n = min(left[k] // each for k, each in pieces.items())
        spent = n * (capacity - sum(pattern))
        if waste + spent > (fewest - 1) * capacity - total:
            continue
        change(pieces, -n)
        path.append((pieces, pattern, n, options))
        used, waste, options = used + n, waste + spent, None
    return best


def pieces(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text",
           capacity: int = CAPACITY, end: int = END_OF_TEXT) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every document, by one pass.

    A document is its token ids and ``end``. Longer ones are cut into pieces of
    ``capacity``, of which the first may be shorter. Null texts count as empty.
    """
    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS_AT_ONCE):
                part = batch.slice(at, _ROWS_AT_ONCE)
                owner, rows = [], []
                for k, ids in enumerate(token_ids(vocabulary).encode(part.column(1).to_pylist())):
                    whole = np.append(ids, end).astype("<u4")
                    first = (len(whole) - 1) % capacity + 1
                    start = [0, *range(first, len(whole), capacity)]
                    for piece, (a, b) in enumerate(zip(start, [*start[1:], len(whole)])):
                        owner.append(k)
                        rows.append((piece, a, b - a, zlib.crc32(whole[a:b].tobytes())))
                columns = [pa.array(c, t) for c, t in zip(
                    zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner)), *columns],
                    [key, "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(
        cut_up, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def placed(found: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """Rows with a ``length`` in 1 .. capacity, with ``sequence_id`` and ``offset``.

    Sequences are filled from offset 0 without gaps. The ranks of the pieces of one length
    are taken in hashed parts, whose sizes are added up first, so a length that very many
    pieces have is not ranked in one task. Equal rows are interchangeable. The search sees
    one number for each length. An empty table gives no rows.
    """
    rows = cut(found)
    names = rows.columns
    mark = F.xxhash64(*names)
    n = rows.count()
    parts = max(64, n // 200_000)
    dealt = rows.withColumn("part", F.pmod(mark, F.lit(parts)).cast("int"))
    counts = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = counts.select("length", "part", (F.sum("n").over(
        Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(
        F.sum("n").alias("n")).collect()}  # one row for each length, at most ``capacity``
    keys, ranks, sequences, offsets = [], Counter(), [], []
    number = 0
    for pattern, times in bin_completion(by_length, capacity, nodes):
        offset = 0
        for length in pattern:
            keys.append(length << _RANK_BITS | ranks[length])
            sequences.append(number)
            offsets.append(offset)
            ranks[length] += times
            offset += length
        number += times
    order = np.argsort(np.array(keys, np.int64))
    table = rows.sparkSession.sparkContext.broadcast(
        tuple(np.array(x, np.int64)[order] for x in (keys, sequences, offsets)))
    ranked = dealt.withColumn("own", F.row_number().over(
        Window.partitionBy("length", "part").orderBy(*(c for c in names if c != "length"))) - 1
    ).join(before, ["length", "part"]).select(
        *names, (F.col("own") + F.col("before")).alias("rank"))

    def found_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, first, offset = table.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(starts, length << _RANK_BITS | rank, side="right") - 1
            sequence = first[at] + rank - (starts[at] & ((1 << _RANK_BITS) - 1))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset[at])],
                [*names, "sequence_id", "offset"])

    kinds = dict(rows.dtypes)
    return ranked.mapInArrow(found_places, ", ".join(
        [f"`{c}` {kinds[c]}" for c in names] + ["sequence_id long, offset long"]))


def packed(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text",
           capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """The pieces of all documents with their sequence and their offset in it.

    Columns: ``key``, ``piece`` (from 0), ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset``. Repeated rows and keys are documents of their own; null
    keys stay null; other columns are left out.
    """
    return placed(pieces(docs, vocabulary, key, text, capacity), capacity, nodes)

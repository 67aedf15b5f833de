"""Counts of hashed keys over a whole corpus, filled in one pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counters of a table: 8 MB in a task, 1 MB told to the tasks as ranks.
CELLS = 1 << 20
#: Counters of a table of frequent keys alone: 16 MB on the driver, 8 MB told to the tasks.
FREQUENT_CELLS = 1 << 23
_CHUNK = 1 << 14
_KEYS_AT_ONCE = 1 << 21
_SKIPPED_BITS, _MOST_BITS = 20, 44


def cell_of(keys: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """The counter of each 64-bit hash."""
    return (keys >> np.uint64(_SKIPPED_BITS)).astype(np.int64) & (cells - 1)


def slot_column(key: Column, bits: int) -> Column:
    """:func:`cell_of` of ``1 << bits`` cells, of a column of longs."""
    return F.shiftrightunsigned(key, _SKIPPED_BITS).bitwiseAND(F.lit((1 << bits) - 1))


def bits_for(slots: int) -> int:
    """Bits of slot numbers, so that there are as many slots at least, as far as hashes go."""
    return min(_MOST_BITS, max(FREQUENT_CELLS, slots - 1).bit_length())


def _packed(numbers: np.ndarray) -> bytes:
    return pa.compress(numbers.view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 8 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(np.int64).ravel()


def tallied(df: DataFrame, column: str, keys_of: Callable[[pa.Array], Iterator[np.ndarray]],
            bits: int, keys: int, least: int) -> DataFrame:
    """(``slot``, ``n``) of the slots on which at least ``least`` keys fall.

    ``keys_of`` gives the 64-bit hashes in a part of the column; there are some ``keys`` of
    them in all. Tasks count their own keys and hand on the sorted slots by their low bits, as
    packed differences: a byte or two for a key, and a row for each two tasks at most
    for a key that all rows hold.
    """
    low = max(4, (keys >> 20).bit_length())

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts(seen: list[np.ndarray]) -> pa.RecordBatch:
            slots, n = np.unique(np.concatenate(seen), return_counts=True)
            bucket = slots & ((1 << low) - 1)
            order = np.argsort(bucket, kind="stable")
            slots, n, bucket = slots[order] >> low, n[order].astype(np.int64), bucket[order]
            start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
            rows = [(int(bucket[a]), int(b - a), _packed(np.diff(slots[a:b], prepend=0)), _packed(n[a:b] - 1))
                    for a, b in zip(start, [*start[1:], len(bucket)])]
            kinds = pa.int32(), pa.int32(), pa.binary(), pa.binary()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                ["bucket", "size", "slots", "more"])

        seen, total = [], 0
        for batch in batches:
            for found in keys_of(batch.column(0)):
                seen.append(cell_of(found.view(np.uint64), 1 << bits))
                total += len(found)
                if total >= _KEYS_AT_ONCE:
                    yield parts(seen)
                    seen, total = [], 0
        if total:
            yield parts(seen)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for bucket, *part in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(bucket, []).append(part)
        for bucket, mine in held.items():
            slots, at = np.unique(np.concatenate(
                [np.cumsum(_unpacked(packed, size)) for size, packed, _ in mine]), return_inverse=True)
            n = np.bincount(at, np.concatenate(
                [_unpacked(more, size) + 1 for size, _, more in mine]), len(slots)).astype(np.int64)
            often = n >= least
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots[often] << low | bucket), pa.array(n[often])], ["slot", "n"])

    parts = df.select(column).mapInArrow(local, "bucket int, size int, slots binary, more binary")
    return parts.repartition("bucket").mapInArrow(added, "slot long, n long")


def frequent(df: DataFrame, column: str, keys_of: Callable[[pa.Array], Iterator[np.ndarray]],
             keys: int, least: int) -> np.ndarray:
    """A table of ``FREQUENT_CELLS`` counters with the counts of frequent keys alone.

    Keys are counted on as many slots as there are keys, so that those that occur at least
    ``least`` times stand out whatever the size of the corpus. The driver gets these.
    """
    found = tallied(df, column, keys_of, bits_for(keys), keys, least)
    cell = F.col("slot").bitwiseAND(F.lit(FREQUENT_CELLS - 1)).cast("int").alias("cell")
    rows = found.select(cell, F.least("n", F.lit((1 << 16) - 1)).cast("int").alias("n")).toArrow()
    table = np.zeros(FREQUENT_CELLS, np.uint16)
    np.maximum.at(table, rows.column("cell").to_numpy(), rows.column("n").to_numpy().astype(np.uint16))
    return table


def counted(df: DataFrame, column: str, keys_of: Callable[[object], np.ndarray],
            cells: int = CELLS) -> np.ndarray:
    """How many keys fall on each counter, over every row of ``df``.

    Each task sums its rows in a table of its own and hands it on in chunks; chunks are
    added up as they come, so no task holds more than one table whatever the number of
    rows or tasks. The driver gets ``cells`` numbers.
    """
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(cells, np.int64)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                np.add.at(table, cell_of(keys_of(value), cells), 1)
        for k in np.flatnonzero(np.add.reduceat(table, np.arange(0, cells, _CHUNK))).tolist():
            part = table[k * _CHUNK:(k + 1) * _CHUNK]
            # Few counters need more than four bytes; those go on in further rows.
            while part.any():
                low = np.minimum(part, (1 << 32) - 1)
                part = part - low
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([low.astype(np.uint32).tobytes()], pa.binary())],
                    ["chunk", "counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(counts, np.uint32)
                if k in sums:
                    sums[k] += part
                else:
                    sums[k] = part.astype(np.int64)
        for k, part in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["chunk", "counts"])

    schema = "chunk int, counts binary"
    table = np.zeros(cells, np.int64)
    parts = df.select(column).mapInArrow(local, schema).repartition("chunk").mapInArrow(added, schema)
    for row in parts.collect():
        table[row["chunk"] * _CHUNK:(row["chunk"] + 1) * _CHUNK] += np.frombuffer(row["counts"], np.int64)
    return table


def ranks(table: np.ndarray) -> np.ndarray:
    """0 for counters as full as chance fills them, else rising with the logarithm."""
    mean = table.mean()
    usual = mean + max(12.0, 5 * mean ** 0.5)
    often = np.flatnonzero(table > usual)
    found = np.zeros(len(table), np.uint8)
    found[often] = np.clip(np.log2(np.maximum(table[often] - mean, 1.0)) * 4, 1, 255)
    return found

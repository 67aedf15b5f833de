"""Approximate nearest neighbours by learned partitions.

A sample's neighbour graph is cut into balanced parts, a small classifier learns which
parts hold the neighbours of a vector, every vector is filed under its most probable part,
and a query is compared exactly with all vectors of its most probable parts.

Nearness is the inner product, so lengths count: a vector is filed with one coordinate more,
which makes all equally long and is zero for a query. The few longest are in a part of their
own that every query visits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordloom.session import cut

#: The most vectors that the graph and the classifier are fitted on.
SAMPLE = 8_192
#: Vectors for each part aimed at, and the most parts.
PART_ROWS, MOST_PARTS = 512, 256
#: Share of the true neighbours that the sample's held-out queries must find, and their number.
RECALL, HELD_OUT = 0.93, 1_024
#: Rows longer than this share of the sample, with a margin for rounding, are in every query's list.
LONG, LONG_MARGIN = 0.99, 1.01
#: Most vectors and queries that meet in one task at a time.
CELL_VECTORS, CELL_QUERIES = 8_192, 4_096
_GRAPH_NEIGHBOURS, _STEPS, _AT_ONCE = 16, 1_000_000, 256


def _lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(1))


def _even(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with a coordinate more, all of length 1: nearest then means largest product."""
    x = vectors / longest
    x = np.column_stack([x, np.sqrt(np.maximum(1 - (x * x).sum(1), 0))])
    return x / _lengths(x)[:, None]


@dataclass(frozen=True)
class Router:
    """A linear classifier over parts, and how many parts a query visits."""

    weights: np.ndarray
    bias: np.ndarray
    visits: int
    longest: float = np.inf

    @property
    def parts(self) -> int:
        """Parts of the classifier; the part with this number holds the longest vectors."""
        return len(self.bias)

    def ranked(self, queries: np.ndarray) -> np.ndarray:
        """Parts of each query, most probable first."""
        if self.parts == 1:
            return np.zeros((len(queries), 1), np.int64)
        x = queries / _lengths(queries)[:, None]
        return np.argsort(-(x @ self.weights[:-1] + self.bias), axis=1, kind="stable")

    def filed(self, vectors: np.ndarray) -> np.ndarray:
        """The part of each vector."""
        if self.parts == 1:
            return np.zeros(len(vectors), np.int64)
        part = np.argmax(_even(vectors, self.longest) @ self.weights + self.bias, axis=1)
        return np.where(_lengths(vectors) > LONG_MARGIN * self.longest, self.parts, part)


def _neighbours(x: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` vectors with the largest inner product, the own left out."""
    k = min(k, len(x) - 1)
    found = []
    for at in range(0, len(of), 512):
        rows = of[at:at + 512]
        scores = x[rows] @ x.T
        scores[np.arange(len(rows)), rows] = -np.inf
        found.append(np.argpartition(-scores, k - 1, axis=1)[:, :k])
    return np.concatenate(found)


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 5) -> np.ndarray:
    """Parts of equal size, few edges between them: halves by the graph's slowest
    vibration, improved by swaps, and each half again."""
    n, k = graph.shape
    a, b = np.repeat(np.arange(n), k), graph.ravel()
    ends, others = np.concatenate([a, b]), np.concatenate([b, a])
    part = np.zeros(n, np.int64)
    rng = np.random.default_rng(seed)
    size = 1
    while size < parts:
        inside = part[ends] == part[others]
        e, o = ends[inside], others[inside]
        degree = np.bincount(e, minlength=n) + 1.0
        members = np.bincount(part, minlength=size)
        y = rng.normal(size=n)
        for _ in range(40):
            y = (y + np.bincount(e, y[o], n)) / degree
            y -= (np.bincount(part, y * degree, size) / np.bincount(part, degree, size))[part]
            y /= np.sqrt(np.bincount(part, y * y, size) / members)[part] + 1e-12
        order = np.lexsort((y, part))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n) - np.repeat(np.cumsum(members) - members, members)
        half = (place >= members[part] // 2).astype(np.int64)
        for _ in range(8):  # swap equal numbers of nodes that have more edges across
            across = np.bincount(e, (half[e] != half[o]).astype(float), n)
            gain = 2 * across - (degree - 1)
            moved = np.zeros(n, bool)
            for p in range(size):
                own = np.flatnonzero((part == p) & (gain > 0))
                left, right = own[half[own] == 0], own[half[own] == 1]
                m = min(len(left), len(right)) // 2
                for side in (left, right):
                    moved[side[np.argsort(-gain[side], kind="stable")[:m]]] = True
            if not moved.any():
                break
            half[moved] = 1 - half[moved]
        part, size = 2 * part + half, 2 * size
    return part


def fit(sample: np.ndarray, parts: int, k: int, recall: float = RECALL) -> Router:
    """A router fitted on the different vectors of a sample.

    About ``HELD_OUT`` of them, an eighth at most, are kept out and only say how many parts to visit.
    """
    whole = sample[np.sort(np.unique(sample, axis=0, return_index=True)[1])]
    asked = np.arange(0, len(whole), max(8, len(whole) // HELD_OUT))
    sample = np.delete(whole, asked, axis=0)
    n, dims = sample.shape
    while parts > 1 and n < 4 * parts:
        parts //= 2
    if parts <= 1:
        return Router(np.zeros((dims + 1, 1)), np.zeros(1), 1)
    lengths = _lengths(sample)
    longest = float(np.quantile(lengths, LONG, method="higher"))
    scaled = (sample / longest).astype(np.float32)
    x = _even(sample, longest).astype(np.float32)
    graph = _neighbours(x, np.arange(n), _GRAPH_NEIGHBOURS)
    part = balanced_parts(graph, parts)

    def shares(near: np.ndarray, own: float) -> np.ndarray:
        target = np.zeros((n, parts), np.float32)
        for column in near.T:
            target[np.arange(n), part[column]] += 1
        target[np.arange(n), part] += own * near.shape[1]
        return target / target.sum(1, keepdims=True)

    target = shares(graph, 0.25)
    if lengths.min() * LONG_MARGIN < longest:  # as a query a vector has other neighbours
        asking = np.column_stack([sample / lengths[:, None], np.zeros(n)]).astype(np.float32)
        near = _neighbours(scaled, np.arange(n), _GRAPH_NEIGHBOURS)
        x, target = np.concatenate([x, asking]), np.concatenate([target, shares(near, 0.0)])
    w, c = np.zeros((dims + 1, parts), np.float32), np.zeros(parts, np.float32)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(c), np.zeros_like(c)]
    for step in range(1, 201):
        scores = x @ w + c
        scores -= scores.max(1, keepdims=True)
        error = np.exp(scores)
        error = (error / error.sum(1, keepdims=True) - target) / len(x)
        for value, slope, one, two in ((w, x.T @ error, *moments[:2]), (c, error.sum(0), *moments[2:])):
            one += 0.1 * (slope - one)
            two += 0.01 * (slope * slope - two)
            value -= 0.2 * (one / (1 - 0.9 ** step)) / (np.sqrt(two / (1 - 0.99 ** step)) + 1e-12)
    router = Router(w.astype(float), c.astype(float), parts, longest)
    # Visit as many parts as the queries held out need to find the share asked for.
    ranked = router.ranked(whole[asked])
    place = np.zeros((len(asked), parts + 1), np.int64)  # the longest are met at once
    np.put_along_axis(place, ranked, np.arange(parts)[None, :].repeat(len(asked), 0), 1)
    true = _neighbours((whole / longest).astype(np.float32), asked, k)
    needed = np.take_along_axis(place, router.filed(whole)[true], 1).ravel()
    found = np.cumsum(np.bincount(needed, minlength=parts)) / len(needed)
    return replace(router, visits=int(np.argmax(found >= min(recall, found[-1]))) + 1)


def _usable(vector: Column) -> Column:
    """Not null, not zero, every component a finite number."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0)


def _best(queries: pa.Table, vectors: pa.Table, k: int) -> list[tuple]:
    """(query, vector, score) of the best ``k`` of each query within one cell."""
    def read(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        table = table.combine_chunks()
        ids = table.column("id").to_numpy()
        column = table.column("vector").combine_chunks()
        return ids, column.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)

    out: list[tuple] = []
    if not queries.num_rows or not vectors.num_rows:
        return out
    (qid, q), (vid, v) = read(queries), read(vectors)
    filed = vectors.column("part").to_numpy()
    parts = queries.combine_chunks().column("parts").combine_chunks()
    visited = np.zeros((len(qid), 1 + max(int(filed.max()), int(max(parts.flatten().to_numpy())))), bool)
    visited[np.repeat(np.arange(len(qid)), parts.value_lengths().to_numpy()), parts.flatten().to_numpy()] = True
    # Of equal vectors only the first ids can be among the best; the own may be one more.
    order = np.argsort(vid, kind="stable")
    vid, v, filed = vid[order], v[order], filed[order]
    _, kind = np.unique(v, axis=0, return_inverse=True)
    kind = kind.ravel()
    pair = np.lexsort((vid, kind))
    fresh = np.ones(len(pair), bool)
    fresh[1:] = (kind[pair][1:] != kind[pair][:-1]) | (vid[pair][1:] != vid[pair][:-1])
    pair = pair[fresh]
    start = np.flatnonzero(np.append(True, kind[pair][1:] != kind[pair][:-1]))
    rank = np.arange(len(pair)) - np.repeat(start, np.diff(np.append(start, len(pair))))
    keep = np.sort(pair[rank <= k])
    vid, v, filed = vid[keep], v[keep], filed[keep]
    repeated = len(np.unique(vid)) < len(vid)
    for at in range(0, len(qid), _AT_ONCE):
        ids, block = qid[at:at + _AT_ONCE], q[at:at + _AT_ONCE]
        scores = block @ v.T
        scores[(ids[:, None] == vid[None, :]) | ~visited[at:at + _AT_ONCE][:, filed]] = -np.inf
        if len(vid) > k + 1 and not repeated:
            border = np.partition(scores, len(vid) - k, axis=1)[:, len(vid) - k]
            near = scores >= np.where(np.isfinite(border), border - 1e-9 * np.abs(border), -np.inf)[:, None]
        else:
            near = np.ones_like(scores, bool)
        near &= np.isfinite(scores)
        row, column = np.nonzero(near)
        for part in range(0, len(row), 1 << 16):
            r, c = row[part:part + (1 << 16)], column[part:part + (1 << 16)]
            scores[r, c] = (block[r] * v[c]).sum(1)  # one order of sums for every pair
        exact = scores[row, column]
        order = np.lexsort((vid[column], -exact, row))
        row, column, exact = row[order], column[order], exact[order]
        if repeated:  # one id with several vectors: its best counts
            seen = np.lexsort((-exact, vid[column], row))
            first = np.append(True, (row[seen][1:] != row[seen][:-1])
                              | (vid[column][seen][1:] != vid[column][seen][:-1]))
            chosen = np.sort(seen[first])
            row, column, exact = row[chosen], column[chosen], exact[chosen]
        start = np.searchsorted(row, row, side="left")
        top = np.arange(len(row)) - start < k
        out.append((ids[row[top]], vid[column[top]], exact[top]))
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id",
           vector: str = "embedding", sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, ``key``, score): the ``k`` nearest found of every query row.

    Nearness is the largest inner product in double precision; ties go to the smaller key.
    Candidates are all rows but those with the query's own key; with fewer than ``k`` a
    query gets what there is. Vectors that are null, zero, or hold a null or a non-finite
    component take no part, nor do those of another length than most, nor null keys. Of rows
    that repeat a key the nearest counts once.

    The router is fitted on at most about ``sample`` vectors, one of an id; every row is filed by it.
    A query visits as many parts as the sample needs for ``recall``, and more where these hold
    fewer than ``k`` others. A part of any size, such as that of a vector which a third of all rows repeat, is dealt
    into blocks that meet blocks of the queries, so a task's work is bounded.
    """
    kind = dict(vectors.dtypes)[key]
    rows = vectors.select(
        F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks")).filter(
        F.col("id").isNotNull() & _usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("size")).agg(
        F.count("*").alias("count"), F.approx_count_distinct("id").alias("ids")).orderBy(
        F.desc("count"), F.desc("size")).first()
    schema = f"query_id {kind}, rank int, `{key}` {kind}, score double"
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.filter(F.size("vector") == lengths["size"])
    n = lengths["count"]
    parts = 1 << max(0, min(MOST_PARTS, n // PART_ROWS).bit_length() - 1)
    taken = rows.filter(F.pmod(F.xxhash64("id"), F.lit(_STEPS)) < int(_STEPS * sample / lengths["ids"])) \
        if lengths["ids"] > sample else rows
    # One vector of an id, which any number of rows may repeat.
    learned = taken.groupBy("id").agg(F.min("vector").alias("vector")).toArrow().sort_by("id") \
        if parts > 1 else None
    router = fit(learned.column("vector").combine_chunks().flatten().to_numpy().reshape(
        learned.num_rows, -1), parts, k, recall) if learned else Router(
        np.zeros((lengths["size"] + 1, 1)), np.zeros(1), 1)
    parts = router.parts

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(router.filed(x), pa.int32())], [*batch.schema.names, "part"])

    files = cut(rows.mapInArrow(filed, f"id {kind}, vector array<double>, asks boolean, part int"))
    sizes = {r["part"]: r["count"] for r in files.groupBy("part").count().collect()}
    always = [parts] if parts in sizes else []
    # Every id counts in one of its parts, so that a sum over parts counts none twice.
    ids = {r["part"]: r["count"] for r in files.groupBy("id").agg(
        F.min("part").alias("part")).groupBy("part").count().collect()}
    ids = np.array([ids.get(part, 0) for part in range(parts)])

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            ranked = router.ranked(x)
            # As many parts as usual, and further ones until they hold k ids besides the own.
            short = (np.cumsum(ids[ranked], axis=1) <= k).sum(1) + 1
            visited = [[*always, *own[:max(router.visits, n)]] for own, n in zip(ranked.tolist(), short.tolist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(visited, pa.list_(pa.int32()))], [*batch.schema.names, "parts"])

    cells, filling = {}, 0  # neighbouring parts share a cell as far as they fit
    for part in range(parts + 1):
        if filling + sizes.get(part, 0) > CELL_VECTORS and filling:
            filling = 0
        fresh = not filling
        cells[part] = (max(cells.values(), default=-1) + 1) if fresh else cells[part - 1]
        filling += sizes.get(part, 0)
    held = dict.fromkeys(cells.values(), 0)
    for part, size in sizes.items():
        held[cells[part]] += size
    cell_of = F.create_map(*(F.lit(x) for item in cells.items() for x in item))
    blocks = F.create_map(*(F.lit(x) for c, size in held.items() for x in (
        c, max(1, -(-size // CELL_VECTORS)))))
    turns = F.lit(max(1, -(-files.filter("asks").count() // CELL_QUERIES)))

    def dealt(df: DataFrame, own: Column, other: Column, mine: str, every: str) -> DataFrame:
        """Rows with the blocks of the other side that they meet in their cell."""
        return df.withColumn(mine, F.pmod(F.xxhash64("id"), own).cast("int")).withColumn(
            every, F.explode(F.sequence(F.lit(0), other - 1)))

    in_cell = F.element_at(blocks, F.col("cell"))
    asking = files.filter("asks").select("id", "vector").mapInArrow(
        routed, f"id {kind}, vector array<double>, parts array<int>")
    left = dealt(asking.select("id", "vector", "parts", F.explode(F.array_distinct(
        F.transform("parts", lambda p: F.element_at(cell_of, p)))).alias("cell")), turns, in_cell, "q", "v")
    right = files.select("id", "vector", "part")
    right = dealt(right.withColumn("cell", F.element_at(cell_of, F.col("part"))), in_cell, turns, "v", "q")

    def compared(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found = _best(queries, candidates, k)
        columns = [np.concatenate(c) for c in zip(*found)] if found else [[], [], []]
        return pa.table({
            "query_id": pa.array(columns[0], queries.schema.field("id").type),
            key: pa.array(columns[1], queries.schema.field("id").type),
            "score": pa.array(columns[2], pa.float64())})

    near = left.groupBy("cell", "v", "q").cogroup(right.groupBy("cell", "v", "q")).applyInArrow(
        compared, f"query_id {kind}, `{key}` {kind}, score double")
    # Few rows for each query: at most k for each block of the parts it visits.
    best = near.groupBy("query_id", key).agg(F.max("score").alias("score")).groupBy("query_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct(
            (-F.col("score")).alias("far"), F.col(key).alias("id"), "score"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("place", "b")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("b.id").alias(key),
        F.col("b.score").alias("score"))

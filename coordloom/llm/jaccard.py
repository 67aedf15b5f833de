"""Exact Jaccard join of word shingles: a size-aware heavy-light join.

Sets of up to a boundary size find partners by the subsets of fixed size that a link
needs both to hold; larger sets scan inverted lists of their rarest shingles. The boundary
is where listing subsets would cost more than scanning lists, by the lengths of the lists in
the data. A list of few sets is scanned pair by pair. Sets that meet in many long ones form
a cluster, whose sets are compared block by block as products of incidence matrices; such a
comparison gives links enough to connect what is linked, never the pairs.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordloom.llm.bloom import blocks_for, block_of, filled, mask_of, sifted, without
from coordloom.llm.counters import bits_for, cell_of, frequent, ranks, slot_column, tallied
from coordloom.llm.graph import components
from coordloom.session import cut, new_folder, scratch

SHINGLE_WORDS = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: A list of more sets than this is not paired out; sets that share several make a cluster.
LONG_LIST = 16
#: Prefixes are so much longer than one common shingle asks for, and linked sets share so
#: many more in them. A set with fewer shingles in long lists has no partner by these alone.
EXTRA = 4
#: Sets and shingles of a block of a cluster; a task holds two blocks.
BLOCK_SETS, BLOCK_SHINGLES = 1_024, 1 << 20
_FEW_HOLDERS, _COLUMNS = 8, 2_048
#: Slots for each entry of the lists, where entries that share none are told from others.
_SLOTS = 64
_LARGEST_BOUNDARY = 16
_ROWS_AT_ONCE = 512
_WORDS_REMEMBERED = 500_000
_BYTES_PER_WORD = 6
_WEIGHTS = np.random.default_rng(11).integers(1, 1 << 64, 8, np.uint64) | np.uint64(1)


def needed(s: int, t: int, percent: int = PERCENT) -> int:
    """The smallest intersection with which sets of sizes ``s`` and ``t`` link."""
    return -(-percent * (s + t) // (100 + percent))


class _Hashes(dict):
    """Hashes of words, as a cache of bounded size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _WORDS_REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_HASHES = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles; A-Z lower-cased, one shingle if too short."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    if len(words) < size:  # told apart from full shingles by the length
        whole = xxhash.xxh3_64_intdigest(hashes.tobytes() + bytes([len(words)]))
        return np.array([whole], np.uint64)
    n = len(hashes) - size + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(size):
        mixed = _mix(mixed + hashes[k:k + n] * _WEIGHTS[k % 8])
    return np.unique(mixed)


def _signature(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set as two longs."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), np.int64).tolist())


def prefix_length(size: int, percent: int = PERCENT) -> int:
    """So many of its first shingles, in any common order, meet those of every partner."""
    return size - -(-percent * size // 100) + 1


@lru_cache(256)
def subset_sizes(size: int, boundary: int, percent: int = PERCENT) -> tuple[int, ...]:
    """Intersections by which a set meets partners, the smaller one within the boundary."""
    sizes = set()
    for other in range(-(-percent * size // 100), 100 * size // percent + 1):
        if 0 < min(size, other) <= boundary:
            c = needed(size, other, percent)
            if c <= min(size, other):
                sizes.add(c)
    return tuple(sorted(sizes))


@dataclass(frozen=True)
class _Pass:
    """What one pass over the texts emits, besides the key and the set's signature."""

    tokens: str  # "prefix", "all", "subsets"
    percent: int = PERCENT
    boundary: int = 0
    common: object = None  # broadcast ranks of counters

    def of(self, tokens: np.ndarray) -> np.ndarray:
        if self.tokens == "all":
            return tokens
        if self.tokens == "subsets":
            made = [
                xxhash.xxh3_64_intdigest(np.array(part, np.uint64).tobytes() + bytes([c]))
                for c in subset_sizes(len(tokens), self.boundary, self.percent)
                for part in combinations(tokens.tolist(), c)]
            return np.array(made, np.uint64)
        rank = self.common.value[cell_of(tokens, len(self.common.value))]
        order = np.argsort(rank, kind="stable") if rank.any() else slice(None)
        return tokens[order][:prefix_length(len(tokens), self.percent) + EXTRA]


def _shingled(docs: DataFrame, emit: _Pass, size: int = SHINGLE_WORDS) -> DataFrame:
    """(id, n, s1, s2, tokens) of every row of (id, text) with at least one word."""
    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS_AT_ONCE):
                part = batch.slice(at, _ROWS_AT_ONCE)
                rows = []
                for text in part.column(1).to_pylist():
                    tokens = shingle_set(text, size)
                    rows.append((len(tokens), *_signature(tokens),
                                 emit.of(tokens).view(np.int64) if len(tokens) else []))
                longs, kinds = pa.int64(), pa.list_(pa.int64())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (longs, longs, longs, kinds))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *columns], ["id", "n", "s1", "s2", "tokens"])

    kind = dict(docs.dtypes)["id"]
    return docs.select("id", "text").mapInArrow(
        shingled, f"id {kind}, n long, s1 long, s2 long, tokens array<long>"
    ).withColumn("who", F.xxhash64("id"))


def _of_classes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of a pass that stand for a class, those of its first id, one for each node. The id
    is part of the key, so the copies of a text do not meet in one task."""
    keys = ["s1", "s2", "who"]
    return rows.drop("id").dropDuplicates(keys).join(classes, keys).drop(*keys)


def _passed_again(texts: DataFrame, classes: DataFrame, nodes: DataFrame, emit: _Pass,
                  size: int) -> DataFrame:
    """Another pass over the texts that stand for the given nodes, and few others."""
    wanted = cut(classes.join(nodes, "node"))
    near = sifted(texts, "id", wanted, "first")
    return _of_classes(_shingled(near, emit, size), wanted.select("node", "s1", "s2", "who"))


def _own(full: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, n, tokens) of the classes, from the rows that are their nodes. Few rows move."""
    places = full.select("at")
    nodes = classes.select(F.col("node").alias("at"))
    spare = cut(places.join(nodes, "at", "left_anti"))
    others, kept = spare.count(), classes.count()
    few = others <= kept // 8
    one = without(full, "at", spare) if others <= kept else sifted(full, "at", nodes, "at").join(nodes, "at")
    named = one.select(F.col("at").alias("node"), "n", "tokens")
    return named if few else cut(named)


def _packed_sets(texts: DataFrame, classes: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """``nodes`` with the packed text that stands for each: a text takes less than half the bytes of
    its set, and gives the set again where it is needed."""
    wanted = cut(classes.join(nodes, "node"))
    near = sifted(texts, "id", wanted, "first")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS_AT_ONCE):
                part = batch.slice(at, _ROWS_AT_ONCE)
                found = part.column(1).to_pylist()
                signs = [_signature(shingle_set(text, size)) for text in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array([x[k] for x in signs], pa.int64()) for k in (0, 1)),
                     pa.array([zlib.compress((text or "").encode(), 1) for text in found], pa.binary())],
                    ["id", "s1", "s2", "packed"])

    kind = dict(near.dtypes)["id"]
    rows = near.select("id", "text").mapInArrow(packed, f"id {kind}, s1 long, s2 long, packed binary")
    return _of_classes(rows.withColumn("who", F.xxhash64("id")), wanted.drop("first"))


def _unpacked_set(packed: bytes, size: int) -> np.ndarray:
    return shingle_set(zlib.decompress(packed).decode(), size)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, size: int) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose sets (node, packed) link."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("packed").alias("pa")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("packed").alias("pb")), "b")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None, None
        for batch in batches:
            links = []
            for b, first, second in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                if last[0] != b:  # neighbours in the join have the same one
                    last = b, _unpacked_set(second, size)
                x, y = _unpacked_set(first, size), last[1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                links.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(links, pa.bool_()))

    return two.select("a", "b", "pa", "pb").mapInArrow(linked, "a long, b long")


def _held(entries: DataFrame) -> DataFrame:
    """(token, held): the lists of more than one set."""
    return entries.groupBy("token").agg(F.count("*").alias("held")).filter("held > 1")


def boundary(own: DataFrame, held: DataFrame, percent: int = PERCENT) -> int:
    """The size of sets up to which subsets cost less than scanning lists.

    ``own`` has the prefixes (node, n, tokens), ``held`` the lengths of their lists. A set that
    scans lists costs a row for each token of its prefix and one for every other set of each
    list, shared by the two; one that lists subsets costs a row for each. Only sets that the
    largest boundary concerns are looked at, and a few numbers collected.
    """
    top = 100 * _LARGEST_BOUNDARY // percent + 1
    small = own.filter(F.col("n") <= top)
    scans = {r["n"]: r["scanned"] for r in small.filter(F.col("n") <= _LARGEST_BOUNDARY).select(
        "n", F.explode("tokens").alias("token")).join(held, "token", "left").groupBy("n").agg(
        F.sum(1 + (F.coalesce("held", F.lit(1)) - 1) / 2).alias("scanned")).collect()}
    counts = {r["n"]: r["count"] for r in small.groupBy("n").count().collect()}
    cost = {}
    for b in range(_LARGEST_BOUNDARY + 1):
        listed = sum(k * sum(math.comb(u, c) for c in subset_sizes(u, b, percent)) for u, k in counts.items())
        cost[b] = listed + sum(x for n, x in scans.items() if n > b)
    return min(cost, key=lambda b: (cost[b], b))


def _shared(sets: DataFrame) -> DataFrame:
    """(node, n, token) of the tokens of (node, n, tokens) that are in two sets, and few others.

    Most tokens are in one set. These are told apart by a tally of hashed slots, many for each
    entry, before any entry moves as a row.
    """
    total = sets.agg(F.sum(F.size("tokens"))).first()[0] or 0
    bits = bits_for(_SLOTS * total)
    twice = cut(tallied(sets, "tokens", lambda column: [column.flatten().to_numpy()], bits, total, 2).select("slot"))
    entries = sets.select("node", "n", F.explode("tokens").alias("token")).withColumn(
        "slot", slot_column(F.col("token"), bits))
    return cut(sifted(entries, "slot", twice, "slot").drop("slot"))


def _entries(scanned: DataFrame, texts: DataFrame, classes: DataFrame, limit: int, percent: int,
             size: int) -> DataFrame:
    """(node, n, token, listed) of the inverted lists: prefixes of the sets above the boundary,
    subsets of those that may have a partner within it."""
    scanned = scanned.filter(F.col("n") > limit).withColumn("listed", F.lit(False))
    if not limit:
        return scanned
    small = classes.filter(F.col("n") <= 100 * limit // percent).select("node")
    kept = cut(_passed_again(texts, classes.drop("n"), small, _Pass("subsets", percent, limit), size).select(
        "node", "n", F.array_distinct("tokens").alias("tokens")))
    return scanned.unionByName(_shared(kept).withColumn("listed", F.lit(True)))


def _parted(lists: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Short lists, long ones, and (node, far), how many long lists each set is in.

    Linked sets that share a shingle of a short list meet there. Others share shingles of long
    lists only, ``EXTRA + 1`` of them or all that a link needs: sets in fewer leave the long
    lists, some of which are short then.
    """
    far = lists.filter(F.col("held") > LONG_LIST)
    least = F.least(F.lit(EXTRA + 1), F.ceil(percent * F.col("n") / 100))
    counts = cut(far.groupBy("node").agg(
        F.count_if(~F.col("listed")).alias("far"), F.max("listed").alias("any"), F.min("n").alias("n")).select(
        "node", "far", (F.col("any") | (F.col("far") >= least)).alias("stays")))
    stay = cut(far.drop("held").join(counts.filter("stays").select("node"), "node"))
    now = cut(_held(stay))
    stay = stay.join(now, "token")
    long = stay.filter(F.col("held") > LONG_LIST)
    short = lists.filter(F.col("held") <= LONG_LIST).unionByName(stay.filter(F.col("held") <= LONG_LIST))
    return short, long, counts.select("node", "far")


def _clusters(long: DataFrame) -> DataFrame:
    """(node, cluster) of the sets that meet in long lists, directly or by others."""
    heads = long.groupBy("token").agg(F.min("node").alias("b"))
    return components(long.select("token", F.col("node").alias("a")).join(heads, "token").select("a", "b")).select(
        "node", F.col("component").alias("cluster"))


def _meeting(short: DataFrame, clusters: DataFrame, far: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets of different clusters that meet in short lists and may link.

    Of prefixes in one order, two linked sets share so many that the rest of either
    prefix's set cannot make up for fewer, nor can the long lists that both may be in;
    other pairs are left out.
    """
    placed = short.join(clusters.join(far, "node", "full"), "node", "left").withColumns({
        "cluster": F.coalesce("cluster", "node"), "far": F.coalesce("far", F.lit(0))})
    x, y = (placed.select("token", "listed", F.col("node").alias(a), F.col("n").alias(f"n{a}"),
                          F.col("cluster").alias(f"p{a}"), F.col("far").alias(f"f{a}")) for a in "ab")
    least, most = F.least("na", "nb"), F.greatest("na", "nb")
    met = x.join(y, ["token", "listed"]).filter(
        (F.col("a") < F.col("b")) & (F.col("pa") != F.col("pb")) & (100 * least >= percent * most))
    # Shingles of a set behind its prefix: ceil(percent * n / 100) - 1 - EXTRA.
    behind = F.greatest(F.floor((percent * most + 99) / 100) - 1 - EXTRA, F.lit(0))
    both = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))
    return met.groupBy("a", "b", "na", "nb").agg(
        F.count("*").alias("met"), F.max("listed").alias("listed"), F.min(F.least("fa", "fb")).alias("far")).filter(
        F.col("listed") | (F.col("met") + F.col("far") >= both - behind)).select("a", "b")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """How many members each of the left sets shares with each right one; ``right`` may be the
    left ones themselves. Members that few sets hold are counted pair by pair, the others
    as products of incidence matrices."""
    sets = left + (right or [])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    members = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = np.argsort(members, kind="stable")
    owner, members = owner[order], members[order]
    start = np.flatnonzero(np.append(True, members[1:] != members[:-1])) if len(members) else np.zeros(0, np.int64)
    held = np.diff(np.append(start, len(members)))
    wide = len(left) if right is None else len(right)
    shift = 0 if right is None else len(left)
    out = np.zeros(len(left) * wide, np.float64)
    for n in range(2, _FEW_HOLDERS + 1):
        at, cells = start[held == n], []
        for p, q in permutations(range(n), 2):
            a, b = owner[at + p], owner[at + q] - shift
            fits = (a < len(left)) & (b >= 0)
            cells.append(a[fits] * wide + b[fits])
        if len(at):
            out += np.bincount(np.concatenate(cells), minlength=len(out))
    out = out.reshape(len(left), wide)
    often = np.flatnonzero(held > _FEW_HOLDERS)
    for first in range(0, len(often), _COLUMNS):
        some = often[first:first + _COLUMNS]
        column = np.repeat(np.arange(len(some)), held[some])
        place = np.concatenate([np.arange(s, s + h) for s, h in zip(start[some], held[some])])
        matrix = np.zeros((len(sets), len(some)), np.float32)
        matrix[owner[place], column] = 1
        out += matrix[:len(left)] @ matrix[shift:].T
    return out


def spanning(links: np.ndarray, square: bool) -> list[tuple[int, int]]:
    """Edges (row, column) of a forest that connects all that a matrix of links does. In a
    square one rows and columns are the same nodes, else different ones."""
    edges, free_rows, free_columns = [], np.ones(links.shape[0], bool), np.ones(links.shape[1], bool)
    for root in range(links.shape[0]):
        if not free_rows[root]:
            continue
        free_rows[root], todo = False, [(root, True)]
        while todo:
            node, is_row = todo.pop()
            if square:
                fresh = np.flatnonzero(links[node] & free_rows)
                free_rows[fresh] = False
                edges += [(node, k) for k in fresh.tolist()]
                todo += [(k, True) for k in fresh.tolist()]
            elif is_row:
                fresh = np.flatnonzero(links[node] & free_columns)
                free_columns[fresh] = False
                edges += [(node, k) for k in fresh.tolist()]
                todo += [(k, False) for k in fresh.tolist()]
            else:
                fresh = np.flatnonzero(links[:, node] & free_rows)
                free_rows[fresh] = False
                edges += [(k, node) for k in fresh.tolist()]
                todo += [(k, True) for k in fresh.tolist()]
    return edges


def _blocks(clusters: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, cluster, blocks): into how many blocks each cluster is dealt."""
    inside = clusters.join(classes.select("node", "n"), "node")
    held = inside.groupBy("cluster").agg(F.count("*").alias("k"), F.sum("n").alias("total"))
    # Stored, it has a true size: a join by cluster, which may be one hot key, is rarely needed.
    blocks = cut(held.select("cluster", F.greatest(
        F.ceil(F.col("k") / BLOCK_SETS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int").alias("blocks")))
    return clusters.join(blocks, "cluster").select("node", "cluster", "blocks")


def _within(sets: DataFrame, percent: int, size: int) -> DataFrame:
    """Links (a, b) that connect all linked sets of each cluster.

    A cluster is dealt into blocks of bounded size; each two blocks, and each with itself, are
    compared in a group of their own, which gives fewer links than it has sets.
    """
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = sets.filter("cluster is not null").withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "packed")

    def compared(cell: pa.Table) -> pa.Table:
        i, j = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
        nodes, own = cell.column("node").to_numpy(), cell.column("own").to_numpy()
        sets = [_unpacked_set(packed, size) for packed in cell.column("packed").to_pylist()]
        sides = [np.flatnonzero(own == b) for b in ((i,) if i == j else (i, j))]
        left = [sets[k] for k in sides[0]]
        right = None if i == j else [sets[k] for k in sides[1]]
        both = shared_counts(left, right)
        na, nb = (np.array([len(x) for x in side]) for side in (left, left if right is None else right))
        links = 100 * both >= percent * (na[:, None] + nb[None, :] - both)
        edges = spanning(links, right is None)
        a, b = (np.array(x, np.int64) for x in zip(*edges)) if edges else (np.zeros(0, np.int64),) * 2
        return pa.table({"a": nodes[sides[0][a]], "b": nodes[sides[-1][b]]})

    return dealt.groupBy("cluster", "i", "j").applyInArrow(compared, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    percent: int = PERCENT, size: int = SHINGLE_WORDS) -> DataFrame:
    """One row (``key``, ``n_shingles``, ``component_id``) for each row of ``docs``.

    ``component_id`` is the smallest key reachable by links, the row's own included. Rows
    without words, null texts included, have an empty set and no link: their own key is
    their component. Equal sets form one class, whatever their number; classes are linked
    exactly. Repeated rows and keys each keep their row; null keys take part and a
    component of null keys alone has a null id.

    1. Shingles that more than ``LONG_LIST`` texts hold are counted, which orders all: the
       rarer first, those that very many texts share last. Any common order is right; this
       one keeps a passage out of the lists of all texts that have enough else.
    2. Equal sets become classes by a 128-bit signature, with partial minima.
    3. Subsets (small sets) and prefixes (large ones) fill the inverted lists, the boundary
       by their cost. Sets that meet in lists of more than ``LONG_LIST``, and are in
       so many of them that they may link by these alone, form clusters.
    4. Short lists give candidate pairs between clusters, in number at most ``LONG_LIST / 2``
       times that of the lists' entries; verified, those that link are left. Within a
       cluster blocks of sets are compared, which gives links enough to connect it.
    5. The links of both kinds give the components.

    What moves are narrow rows: entries of lists of one set leave before, and sets are moved
    as their packed texts.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    words = (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // _BYTES_PER_WORD
    table = frequent(texts, "text", lambda column: (shingle_set(t, size) for t in column.to_pylist()), words,
                     LONG_LIST + 1)
    order = spark.sparkContext.broadcast(ranks(table))
    rows = cut(_shingled(texts, _Pass("prefix", percent, common=order), size).withColumn(
        "at", F.monotonically_increasing_id()))
    full = rows.filter("n > 0")
    place = new_folder(spark, "classes")
    with scratch(spark) as noted:  # what only leads to the components goes
        classes = cut(full.groupBy("s1", "s2").agg(F.min("n").alias("n"), F.min("id").alias("first"),
                                                   F.min("at").alias("node")).withColumn("who", F.xxhash64("first")))
        own = _own(full, classes)
        scanned = _shared(own)
        held = cut(_held(scanned))
        limit = boundary(own, held, percent)
        entries = _entries(scanned, texts, classes, limit, percent, size)
        if limit:
            held = cut(_held(entries))
        lists = cut(entries.join(held, "token"))
        short, long, far = _parted(lists, percent)
        clusters = cut(_blocks(cut(_clusters(long)), classes))
        pairs = cut(_meeting(short, clusters.select("node", "cluster"), far, percent))
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("paired", F.lit(True))
        sets = cut(_packed_sets(texts, classes, clusters.join(ends, "node", "full"), size))
        links = cut(_verified(pairs, sets.filter("paired"), percent, size).unionByName(_within(sets, percent, size)))
        found = classes.join(components(links), "node", "left").withColumn(
            "component", F.coalesce("component", "node"))
        least = found.groupBy("component").agg(F.min("first").alias("component_id"))
        named = cut(found.join(least, "component").select(
            F.col("s1").alias("c1"), F.col("s2").alias("c2"), "component_id"), place)
    noted.release()
    return full.join(named, (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2"))).select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id").unionByName(
        rows.filter("n = 0").select(F.col("id").alias(key), F.col("n").alias("n_shingles"),
                                    F.col("id").alias("component_id")))


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text",
                  percent: int = PERCENT, size: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with one row left of each component of near duplicates, columns as they were.

    The row with the smallest key stays; keys that repeat are told apart by their texts, and
    of rows with one key and text one stays. Rows without words are kept unless they
    repeat a key and text. Only rows that may have to go move: a filter parts them.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    own = F.struct(F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("h1"),
                   F.xxhash64(F.col(f"`{text}`"), F.lit("2")).alias("h2"))
    keyed = docs.select(F.struct(*names).alias("own"), own.alias("key"))
    found = near_duplicates(keyed.select("key", F.col(f"own.`{text}`").alias("text")),
                            "key", "text", percent, size)
    touched = cut(found.groupBy("key").agg(
        F.count("*").alias("n"), F.min("component_id").alias("component"))
        .filter((F.col("n") > 1) | ~F.col("key").eqNullSafe(F.col("component")))
        .select("key", (F.col("key").eqNullSafe(F.col("component"))).alias("stays")))
    blocks, mask = blocks_for(touched.count()), mask_of(F.col("key"))
    parted = keyed.withColumn("block", block_of(F.col("key"), blocks)).join(
        F.broadcast(filled(touched, "key", blocks)), "block", "left")
    maybe = F.coalesce(F.col("bits").bitwiseAND(mask) == mask, F.lit(False))
    moved = parted.filter(maybe).select("own", "key").join(
        touched.select(F.col("key").alias("of"), "stays"), F.col("key").eqNullSafe(F.col("of")), "left")
    once = moved.filter("stays").groupBy("key").agg(F.first("own").alias("own"))
    return parted.filter(~maybe).select("own").unionByName(
        moved.filter(F.col("stays").isNull()).select("own")).unionByName(once.select("own")).select("own.*")

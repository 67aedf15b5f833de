"""Removal of long repeated passages: winnowed anchors as seeds, extended both ways.

Every window of ``WINDOW`` words has one anchor, its ``SEED``-word run with the smallest
hash, so equal windows have equal anchors at equal places. A window repeats only if its
anchor does. Anchors that occur once, most of them, end the search for all their windows.
The others are compared with everything around them that shares their windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coordloom.llm.bloom import blocks_for, block_of, filled, mask_of, sifted
from coordloom.session import cut

WINDOW = 35
SEED = 8
_ROWS_AT_ONCE = 256
_WORDS_REMEMBERED = 500_000
_BASE = 0x9E3779B97F4A7C15 | 3
_MASK = (1 << 64) - 1


class _Hashes(dict):
    """Hashes of words, as a cache of bounded size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _WORDS_REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


class _Powers:
    """Powers of a base and of its inverse modulo 2^64, as long as asked for."""

    def __init__(self, base: int) -> None:
        self._base, self._inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = 2 * n
            self.up = np.full(size, self._base & _MASK, np.uint64)
            self.down = np.full(size, self._inverse, np.uint64)
            self.up[0] = self.down[0] = 1
            self.up, self.down = np.cumprod(self.up), np.cumprod(self.down)


_HASHES = _Hashes()
_POWERS = _Powers(_BASE)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Runs:
    """Hashes of word runs of one text, by differences of running sums."""

    def __init__(self, words: list[bytes], window: int, seed: int) -> None:
        n = len(words)
        _POWERS.reach(n + 1)
        hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
        self._sums = [np.append(np.uint64(0), np.cumsum(h * _POWERS.up[:n]))
                      for h in (hashes, _mix(hashes))]
        self._window, self._seed = window, seed
        span = window - seed + 1
        seeds = self.of(0, np.arange(n - seed + 1), np.arange(n - seed + 1) + seed)
        value, place, size = seeds, np.arange(len(seeds)), 1
        while size < span:  # the least seed of 2, 4, 8 .. and at last ``span`` neighbours
            step = min(size, span - size)
            left, right = value[:-step], value[step:]
            later = right < left
            place = np.where(later, place[step:], place[:-step])
            value = np.where(later, right, left)
            size += step
        # The windows of one anchor are neighbours.
        self.first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        self.last = np.append(self.first[1:], len(place)) - 1
        self.anchor = place[self.first]

    def of(self, which: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        sums = self._sums[which]
        return _mix((sums[stop] - sums[start]) * _POWERS.down[start])

    def anchors(self) -> np.ndarray:
        return self.of(0, self.anchor, self.anchor + self._seed)

    def surroundings(self) -> np.ndarray:
        """Hashes of all words in the windows of an anchor, and of its place in them."""
        whole = self.of(1, self.first, self.last + self._window)
        shape = (self.anchor - self.first) * 4096 + (self.last - self.first)
        return _mix(whole + shape.astype(np.uint64) * np.uint64(_BASE))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        start = np.arange(int(self.last[-1]) + 1)
        return tuple(self.of(k, start, start + self._window) for k in (0, 1))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _mapped(df: DataFrame, schema: str, work) -> DataFrame:
    """``work`` gives the rows of each text (the last column) after its other columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    types = to_arrow_schema(df.limit(0).select(*df.columns[:-1]).withColumns({
        f.split()[0]: F.lit(None).cast(f.split()[1]) for f in schema.split(", ")}).schema)
    carried = len(df.columns) - 1

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS_AT_ONCE):
                part = batch.slice(at, _ROWS_AT_ONCE)
                made = [list(work(t)) for t in part.column(carried).to_pylist()]
                owner = pa.array(np.repeat(np.arange(len(made)), [len(m) for m in made]))
                rows = [r for m in made for r in m]
                columns = [part.column(k).take(owner) for k in range(carried)]
                news = list(zip(*rows)) if rows else [()] * (len(types) - carried)
                columns += [pa.array(c, types.field(carried + k).type) for k, c in enumerate(news)]
                yield pa.RecordBatch.from_arrays(columns, types.names)

    kinds = dict(df.dtypes)
    return df.mapInArrow(mapped, ", ".join(
        [f"{c} {kinds[c]}" for c in df.columns[:-1]] + [schema]))


def _seeds(texts: DataFrame, window: int, seed: int) -> DataFrame:
    """(id, s1, s2, anchors, around) of the texts with a window."""
    def work(text):
        words = _words(text)
        if len(words) >= window:
            runs = _Runs(words, window, seed)
            yield runs.anchors().view(np.int64), runs.surroundings().view(np.int64)

    return _mapped(texts, "anchors array<long>, around array<long>", work)


def _window_hashes(texts: DataFrame, window: int, seed: int) -> DataFrame:
    """(anchor, around, w1, w2) of every anchor: the hashes of its windows in order."""
    def work(text):
        words = _words(text)
        if len(words) >= window:
            runs = _Runs(words, window, seed)
            one, two = (w.view(np.int64) for w in runs.windows())
            for a, c, i, j in zip(runs.anchors().view(np.int64).tolist(),
                                  runs.surroundings().view(np.int64).tolist(),
                                  runs.first.tolist(), (runs.last + 1).tolist()):
                yield a, c, one[i:j], two[i:j]

    return _mapped(texts.select("text"), "anchor long, around long, w1 array<long>, w2 array<long>", work)


def _signed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("s1"),
                       F.xxhash64(F.col(text), F.lit("2")).alias("s2"), F.col(text).alias("text"))


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
            seed: int = SEED) -> DataFrame:
    """(id, s1, s2, flags): for texts with repeated windows, which of them repeat.

    ``flags`` lists (``anchor``, ``windows``): the number of an anchor in the text, and a
    bit for each of its windows. ``s1`` and ``s2`` are hashes of the text, so that rows
    with one key and different texts are told apart; equal rows share one result.

    An anchor all of whose occurrences have equal surroundings repeats with all its
    windows, and so does one of several surroundings that occurs twice. Only surroundings
    that occur once, where a match ends, are compared window by window, by 128-bit hashes.
    Every grouping has partial sums; occurrences are never paired with each other.
    """
    if not 0 < seed <= window or window - seed > 62:
        raise ValueError("a window takes a seed and at most 62 words more")
    texts = _signed(docs, key, text)
    rows = cut(_seeds(texts, window, seed).withColumn("row", F.monotonically_increasing_id()))
    seen = rows.select("row", F.posexplode(F.arrays_zip("anchors", "around")).alias("k", "x")).select(
        "row", F.col("k").cast("int").alias("k"), F.col("x.anchors").alias("anchor"),
        F.col("x.around").alias("around"))
    again = cut(seen.groupBy("anchor").agg(
        F.count("*").alias("n"), F.min("around").alias("lo"), F.max("around").alias("hi"))
        .filter("n > 1").select("anchor", (F.col("lo") < F.col("hi")).alias("mixed")))
    live = cut(sifted(seen, "anchor", again, "anchor").join(again, "anchor"))
    # Surroundings by how often they occur; of those that occur once, where.
    around = cut(live.filter("mixed").groupBy("anchor", "around").agg(
        F.count("*").alias("n"), F.min("row").alias("row"), F.min("k").alias("k")))
    full = F.lit(-1).cast("long").alias("windows")
    flags = live.filter("NOT mixed").select("row", "k", full).unionByName(
        live.filter("mixed").join(around.filter("n > 1").select("anchor", "around"),
                                  ["anchor", "around"]).select("row", "k", full))

    holders = rows.select("row", "s1").join(around.select("row").distinct(), "row")
    near = sifted(texts, "s1", holders, "s1")
    hashes = sifted(_window_hashes(near, window, seed), "around", around, "around")
    # Copies go where they are made, before the join could bring them together.
    hashes = cut(hashes.dropDuplicates(["anchor", "around"]).join(around, ["anchor", "around"]))
    single = hashes.select("n", "row", "k", F.posexplode(F.arrays_zip("w1", "w2")).alias("o", "w")).select(
        "n", "row", "k", "o", F.col("w.w1").alias("w1"), F.col("w.w2").alias("w2"))
    common = single.groupBy("w1", "w2").agg(F.sum("n").alias("times")).filter("times > 1")
    flags = flags.unionByName(single.filter("n = 1").join(common, ["w1", "w2"]).groupBy("row", "k").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("o"))).alias("windows")))
    per_row = flags.groupBy("row").agg(F.collect_list(F.struct("k", "windows")).alias("flags"))
    return per_row.join(rows.select("row", "id", "s1", "s2"), "row").drop("row").dropDuplicates(
        ["id", "s1", "s2"])


def kept_words(text: str | None, flags, window: int = WINDOW, seed: int = SEED) -> tuple[int, int, str]:
    """Number of words, number removed, and the kept words joined by one blank."""
    words = _words(text)
    if not flags:
        return len(words), 0, b" ".join(words).decode()
    runs = _Runs(words, window, seed)
    edge = np.zeros(len(words) + 1, np.int64)
    for k, bits in flags:
        first, last = int(runs.first[k]), int(runs.last[k])
        starts = range(first, last + 1) if bits == -1 else [
            first + o for o in range(last - first + 1) if bits >> o & 1]
        if bits == -1:
            edge[first] += 1
            edge[last + window] -= 1
            continue
        for at in starts:
            edge[at] += 1
            edge[at + window] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    kept = [w for w, g in zip(words, gone.tolist()) if not g]
    return len(words), len(words) - len(kept), b" ".join(kept).decode()


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept``, the words left, joined by a blank.

    Every word covered by ``window`` consecutive words of its text that also start anywhere
    else, in this text or another, is removed, the first occurrence included; what repeats
    is judged on the input. A row of the same text under the same key counts as another
    text. Null texts have no words. Columns with these names are replaced. Texts without a
    repeat do not move: a Bloom filter of the others parts them.
    """
    found = cut(repeats(docs, key, text, window, seed))
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept")]
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("own"),
                      F.xxhash64(F.col(f"`{text}`")).alias("s1"),
                      F.xxhash64(F.col(f"`{text}`"), F.lit("2")).alias("s2"))
    blocks = blocks_for(found.count())
    sieve = F.broadcast(filled(found, "s1", blocks))
    parted = own.withColumn("block", block_of(F.col("s1"), blocks)).join(sieve, "block", "left")
    mask = mask_of(F.col("s1"))
    maybe = F.coalesce(F.col("bits").bitwiseAND(mask) == mask, F.lit(False))
    marks = found.select(F.col("id").alias("of"), F.col("s1").alias("of1"),
                         F.col("s2").alias("of2"), "flags")
    moved = parted.filter(maybe).join(
        marks, F.col(f"own.`{key}`").eqNullSafe(F.col("of")) & (F.col("s1") == F.col("of1"))
        & (F.col("s2") == F.col("of2")), "left").select("own", "flags")
    still = parted.filter(~maybe).select("own", F.lit(None).cast(dict(marks.dtypes)["flags"]).alias("flags"))
    both = still.unionByName(moved).select(
        "own", "flags", F.col(f"own.`{text}`").alias("text"))

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS_AT_ONCE):
                part = batch.slice(at, _ROWS_AT_ONCE)
                rows = [
                    kept_words(t, [(f["k"], f["windows"]) for f in flags or []], window, seed)
                    for flags, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                n, gone, kept = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                     pa.array(kept, pa.string())], ["own", "n_words", "n_removed", "kept"])

    long = T.LongType()
    made = both.mapInArrow(removed, T.StructType([
        both.schema["own"], T.StructField("n_words", long), T.StructField("n_removed", long),
        T.StructField("kept", T.StringType())]))
    return made.select("own.*", "n_words", "n_removed", "kept")


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars",
            window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``docs`` with repeated passages taken out of their texts, columns as they were.

    Texts without a repeat keep their spacing; in others the words left are joined by one
    blank and ``n_chars``, where there is such a column, is the new length.
    """
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"),
                         F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    found = without_repeats(packed, "key", "text", window, seed)
    changed = F.col("n_removed") > 0
    new = {text: F.when(changed, F.col("kept")).otherwise(F.col("text"))}
    if n_chars in docs.columns:
        new[n_chars] = F.when(changed, F.length("kept")).otherwise(F.col(f"own.`{n_chars}`")).cast(
            dict(docs.dtypes)[n_chars])
    return found.select(*(new.get(c, F.col(f"own.`{c}`")).alias(c) for c in docs.columns))

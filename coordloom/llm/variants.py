"""Spelling variants: words one edit apart, found by an index of variable-length grams.

A dictionary of grams of two to four characters is pruned by frequency: a gram that many
words hold gives way to its extensions, a rare one is not extended. Every word is decomposed
into the longest dictionary grams at its places. One edit at place ``i`` can only affect grams
that end within ``LONGEST`` places from ``i`` on, which bounds for each word how many of its
grams another one may lack. Lists of the grams are merged within these bounds, and what they
give is verified.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordloom.session import cut

SHORTEST, LONGEST = 2, 4
#: Gram occurrences over this many are a frequent gram, which is extended. So the number of
#: frequent grams is at most that of the lengths below ``LONGEST`` times this.
SHARE = 10_000
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A form occurs at least so many times as often as the word.
RATIO = 5
#: Marks of beginning and end, outside the alphabet.
_OPEN, _CLOSE = "^", "$"
_RUNS = re.compile("[a-zÀ-ÿ]+")
_MISPRINTS = 199
_COUNTED_AT_ONCE = 200_000
_ROWS_AT_ONCE = 1_000


def runs_of(key: object, text: str | None, misprint: int = _MISPRINTS) -> Counter:
    """The runs of letters of a text, A-Z lower-cased, with their numbers; of those whose
    hash with the key ``misprint`` divides, one character is left out."""
    found = Counter(_RUNS.findall((text or "").encode().lower().decode()))
    if not misprint or not found:
        return found
    start = zlib.crc32(b"%b:" % str("" if key is None else key).encode())
    out: Counter = Counter()
    for run, n in found.items():
        h = zlib.crc32(run.encode(), start)
        if not h % misprint:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        out[run] += n
    return out


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH,
          least_count: int = LEAST_COUNT, misprint: int = _MISPRINTS) -> DataFrame:
    """(word, n): the runs of letters of at least ``least_length`` characters and ``least_count``
    occurrences in all texts. Tasks count what they read in tables of bounded size first."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def table() -> pa.RecordBatch:
            held = pa.RecordBatch.from_arrays(
                [pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
            seen.clear()
            return held

        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS_AT_ONCE):
                part = batch.slice(at, _ROWS_AT_ONCE)
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for word, n in runs_of(k, t, misprint).items():
                        if len(word) >= least_length:
                            seen[word] += n
                    if len(seen) > _COUNTED_AT_ONCE:
                        yield table()
        yield table()

    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(
        counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(
        F.col("n") >= least_count)


def frequent_grams(vocabulary: DataFrame, share: int = SHARE) -> frozenset[str]:
    """The grams that are extended: those with more than one of ``share`` of all occurrences
    of grams of their length. There are at most ``share`` of each length, so the set is bounded.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def table() -> pa.RecordBatch:
            held = pa.RecordBatch.from_arrays(
                [pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["gram", "n"])
            seen.clear()
            return held

        for batch in batches:
            for word in batch.column(0).to_pylist():
                w = _OPEN + word + _CLOSE
                for size in range(SHORTEST, LONGEST):
                    seen.update(map("".join, zip(*(w[k:] for k in range(size)))))
                if len(seen) > _COUNTED_AT_ONCE:
                    yield table()
        yield table()

    counts = vocabulary.select("word").mapInArrow(counted, "gram string, n long").groupBy("gram").agg(
        F.sum("n").alias("n"))
    marked = F.length("word") + len(_OPEN + _CLOSE)
    total = vocabulary.agg(*(F.sum(marked - (size - 1)).alias(str(size)) for size in range(SHORTEST, LONGEST))).first()
    often = F.array(*(F.lit((n or 0) / share) for n in total))
    return frozenset(r["gram"] for r in counts.filter(
        F.col("n") > F.element_at(often, F.length("gram") - (SHORTEST - 1))).select("gram").collect())


def decomposed(word: str, extended: frozenset[str]) -> list[tuple[int, str]]:
    """(place, gram) of a word with its marks: at each place the longest gram of the
    dictionary, unless one before it covers it."""
    w = _OPEN + word + _CLOSE
    out, covered = [], 0
    for at in range(len(w) - SHORTEST + 1):
        end = at + SHORTEST
        while end - at < LONGEST and end < len(w) and w[at:end] in extended:
            end += 1
        if end > covered:
            out.append((at, w[at:end]))
            covered = end
    return out


def affected(grams: list[tuple[int, str]], length: int) -> int:
    """The most grams of a word that one edit can affect.

    Left of the edit a gram stays, as it ended at a rare gram, at ``LONGEST`` or at a mark. A gram
    that ends ``LONGEST`` or more places behind it starts behind it and no new one covers it. So
    only those that end within ``LONGEST`` places from the edit on are affected; ends are distinct.
    """
    ends = [at + len(g) - 1 for at, g in grams]
    most = first = last = 0
    for i in range(1, length + 2):
        while first < len(ends) and ends[first] < i:
            first += 1
        while last < len(ends) and ends[last] < i + LONGEST:
            last += 1
        most = max(most, last - first)
    return most


def indexed(vocabulary: DataFrame, extended: frozenset[str]) -> DataFrame:
    """(word, n, size, letters, grams, may) of every word.

    ``grams`` lists (place, gram), ``may`` says how many of them one edit can affect, and
    ``letters`` has a bit for each character, of which an edit changes two at most. A word of
    fewer than ``2 * LONGEST - 2`` characters, which may share no gram with one that is near,
    is an error.
    """
    shared = vocabulary.sparkSession.sparkContext.broadcast(extended)

    def tokened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            places, grams, may, letters = [], [], [], []
            for word in batch.column(0).to_pylist():
                if len(word) < 2 * LONGEST - 2:
                    raise ValueError(f"words need {2 * LONGEST - 2} characters for a sure common gram: {word}")
                own = decomposed(word, known)
                places.append([at for at, _ in own])
                grams.append([gram for _, gram in own])
                may.append(affected(own, len(word)))
                letters.append(sum(1 << k for k in {ord(c) % 63 for c in word}))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(places, pa.list_(pa.int32())), pa.array(grams, pa.list_(pa.string())),
                 pa.array(may, pa.int32()), pa.array(letters, pa.int64())],
                ["word", "n", "places", "texts", "may", "letters"])

    return vocabulary.select("word", "n").mapInArrow(
        tokened, "word string, n long, places array<int>, texts array<string>, may int, letters long").select(
        "word", "n", F.length("word").alias("size"), "letters", "may", F.arrays_zip(
            F.col("places").alias("place"), F.col("texts").alias("gram")).alias("grams"))


def near_pairs(vocabulary: DataFrame, share: int = SHARE) -> DataFrame:
    """(a, b, na, nb), ``a < b``: all pairs of different words (word, n) one edit apart.

    Grams that the edit does not affect are at the same place of both words, or as far from
    the end. All but ``may`` grams of either word are such, so the ``may + 1`` rarest of each
    hold one: only these lists are merged, by gram, place and length, a long list thus in many
    parts. A pair that meets there must share all but ``may`` grams of either; then it is verified.
    """
    # Rows of single grams go by a number, as a word may be long.
    rows = cut(indexed(vocabulary, frequent_grams(vocabulary, share)).withColumn(
        "node", F.monotonically_increasing_id()))
    lists = rows.select("node", F.explode("grams").alias("g")).select("node", "g.place", "g.gram")
    held = lists.groupBy("gram").agg(F.count("*").alias("held"))
    # Equal grams of a word stand in the order of their places, in every word.
    rarest = lists.join(held, "gram").groupBy("node").agg(F.array_sort(F.collect_list(
        F.struct("held", "gram", "place"))).alias("by"))
    probes = cut(rows.join(rarest, "node").select(
        "word", "n", "size", "letters", "may", F.transform("by", lambda x: F.hash(x["gram"])).alias("all"),
        F.explode(F.slice("by", F.lit(1), F.col("may") + 1)).alias("x")).select(
        "word", "n", "size", "letters", "may", "all", F.xxhash64("x.gram").alias("gram"), "x.place"))
    # Once a word of equal length, or one longer, left or right of the edit.
    to = F.explode(F.array(*(F.struct((F.col("size") + more).alias("size"), (F.col("place") + later).alias("place"))
                             for more, later in ((0, 0), (1, 0), (1, 1)))))

    def side(name: str) -> list[Column]:
        return [F.col(c).alias(f"{name}_{c}") for c in ("word", "n", "size", "letters", "may", "all")]

    left = probes.select("gram", to.alias("to"), *side("x")).select("gram", "to.size", "to.place", *side_names("x"))
    right = probes.select("gram", "size", "place", *side("y"))
    changed = F.bit_count(F.col("x_letters").bitwiseXOR(F.col("y_letters")))
    common = F.size(F.array_intersect("x_all", "y_all"))
    # Of equal grams one counts, so as many fewer may be common.
    enough = [common >= F.size(F.array_distinct(f"{s}_all")) - F.col(f"{s}_may") for s in "xy"]
    met = left.join(right, ["gram", "size", "place"]).filter(
        ((F.col("x_size") < F.col("y_size")) | (F.col("x_word") < F.col("y_word"))) & (changed <= 2)
        & enough[0] & enough[1] & (F.levenshtein("x_word", "y_word", 1) == 1))
    swap = F.col("x_word") > F.col("y_word")
    return met.select(
        F.least("x_word", "y_word").alias("a"), F.greatest("x_word", "y_word").alias("b"),
        F.when(swap, F.col("y_n")).otherwise(F.col("x_n")).alias("na"),
        F.when(swap, F.col("x_n")).otherwise(F.col("y_n")).alias("nb")).distinct()


def side_names(name: str) -> list[str]:
    return [f"{name}_{c}" for c in ("word", "n", "size", "letters", "may", "all")]


def forms(vocabulary: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, form, form_n, n_near): of the near words the one of largest n, ties to the
    first in the order of code points, if its n is at least ``ratio`` times the word's."""
    both = pairs.select(F.col("a").alias("of"), F.col("b").alias("near"), F.col("nb").alias("m")).unionByName(
        pairs.select(F.col("b").alias("of"), F.col("a").alias("near"), F.col("na").alias("m")))
    best = both.groupBy("of").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("top"))
    large = -F.col("top.less") >= ratio * F.col("n")
    return vocabulary.join(best, F.col("word") == F.col("of"), "left").select(
        "word", "n", F.when(large, F.col("top.near")).alias("form"),
        F.when(large, -F.col("top.less")).alias("form_n"),
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"))


def roots(table: DataFrame, most: int, ratio: int = RATIO) -> DataFrame:
    """``table`` (word, form, ..) with ``root``, the last form reached from a word.

    A form occurs ``ratio`` times as often as its word, so paths are short: with ``most`` for the
    largest n their length is known, and each round doubles what a step spans.
    """
    longest = max(1, math.ceil(math.log(max(most, 2), ratio)) + 1)
    steps = table.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(longest))):
        steps = cut(steps.join(
            steps.select(F.col("word").alias("at"), F.col("root").alias("further")),
            F.col("root") == F.col("at"), "left").select("word", F.coalesce("further", "root").alias("root")))
    return table.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH,
            least_count: int = LEAST_COUNT, ratio: int = RATIO, misprint: int = _MISPRINTS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts.

    Null and empty texts have no words; a null key counts as an empty one. Repeated rows count
    each. Only ``key`` and ``text`` are read, so other columns may have any name. An empty
    table gives no rows. ``misprint`` is the share of runs that lose a character, 0 for none.
    """
    if least_length < 2 * LONGEST - 2 or ratio < 2:
        raise ValueError(f"least_length is at least {2 * LONGEST - 2}, ratio at least 2")
    vocabulary = cut(words(docs, key, text, least_length, least_count, misprint))
    most = vocabulary.agg(F.max("n")).first()[0] or 0
    table = cut(forms(vocabulary, cut(near_pairs(vocabulary)), ratio))
    return roots(table, most, ratio).select("word", "form", "root", "n", "n_near", "form_n")

"""Mixing of sources against a plain computation."""

from __future__ import annotations

from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from conftest_llm import words_of
from pyspark.sql import functions as F

from coordloom.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def plain_targets(sizes: dict, weights=mixing.WEIGHTS, epochs=3) -> dict:
    """Clamp, reshare, repeat."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(epochs * sizes[s] for s in full)
        parts = sum(weight[s] for s in order if s not in full)
        share = {s: Fraction(left * weight[s], parts) for s in order if s not in full}
        over = {s for s, x in share.items() if x > epochs * sizes[s]}
        if not over:
            return {s: Fraction(epochs * sizes[s]) if s in full else share[s] for s in order}
        full |= over


def docs_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def texts(rng, n, sources, least=0, most=60):
    return [(k, " ".join(["w"] * int(rng.integers(least, most))), sources[int(rng.integers(len(sources)))])
            for k in range(n)]


@pytest.mark.parametrize("sources", [
    ["a"], ["b", "a", None], ["a", "b", "c", "d", "é", "Z", None],
    ["big"] * 60 + ["tiny", "small", "other"]])
def test_targets_and_taken(spark, rng, sources):
    rows = texts(rng, 400, sources)
    got = mixing.mixed(docs_of(spark, rows)).collect()
    sizes, taken, largest = Counter(), Counter(), defaultdict(int)
    for r in got:
        assert r.size == len(words_of(dict((k, t) for k, t, _ in rows)[r.doc_id]))
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.repeats * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    want = plain_targets(sizes)
    assert sum(want.values()) == sum(sizes.values())
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(want[r.source]))
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1
        assert len({r.repeats for r in got if r.source == s}) <= 2
    assert len(got) == len(rows)


def test_reruns_agree_however_rows_are_stored(spark, rng):
    rows = texts(rng, 300, ["a", "b", "c", "d"])
    docs = docs_of(spark, rows)
    one = {r.doc_id: r.taken for r in mixing.mixed(docs).collect()}
    two = {r.doc_id: r.taken for r in mixing.mixed(docs.orderBy(F.rand(3)).repartition(7)).collect()}
    assert one == two
    other = {r.doc_id: r.taken for r in mixing.mixed(docs, seed="other").collect()}
    assert one != other


def test_a_third_of_all_rows_is_one_document(spark, rng):
    rows = texts(rng, 200, ["a", "b", "c"], 5) + [(1000, "x y z", "b")] * 100
    expected = None
    for parts in (1, 5):
        got = mixing.mixed(docs_of(spark, rows).repartition(parts)).collect()
        want = plain_targets(Counter({s: sum(r.size for r in got if r.source == s) for s in "abc"}))
        taken = sum(r.taken for r in got if r.source == "b")
        assert abs(taken - want["b"]) <= 30 and len(got) == 300
        rowset = Counter((r.doc_id, r.taken) for r in got)
        assert expected is None or rowset == expected
        expected = rowset


def test_copies_at_the_edge_are_parted(spark):
    rows = [(7, "x y", "a")] * 90 + [(1, "w " * 90, "b"), (2, "w", "c")]
    got = mixing.mixed(docs_of(spark, rows).repartition(6)).collect()
    sizes = {"a": 180, "b": 90, "c": 1}
    want = plain_targets(sizes)
    a = [r.taken for r in got if r.source == "a"]
    assert len(a) == 90 and abs(sum(a) - want["a"]) <= 1.5 and len(set(a)) <= 2


def test_odd_rows(spark):
    rows = [(None, "a b", "s"), (1, None, "s"), (2, "", None), (3, "c", None), (3, "c", None), (4, " \t\n", "t")]
    got = mixing.mixed(docs_of(spark, rows)).collect()
    assert sorted(((r.doc_id or 0), r.size) for r in got) == [(0, 2), (1, 0), (2, 0), (3, 1), (3, 1), (4, 0)]
    assert all(r.target == 0 and r.taken == 0 for r in got if r.source == "t")
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(4.0)
    long_text = [(1, "w " * 200_000, "a"), (2, "v", "b")]
    assert {r.doc_id: r.size for r in mixing.mixed(docs_of(spark, long_text)).collect()} == {1: 200_000, 2: 1}


def test_empty_table_and_no_words(spark):
    assert mixing.mixed(docs_of(spark, [])).collect() == []
    got = mixing.mixed(docs_of(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_clashing_columns(spark):
    docs = docs_of(spark, [(1, "a b c", "s"), (2, "d", "t")]).select(
        "*", F.lit("x").alias("target"), F.lit("y").alias("place"), F.lit(1).alias("a.b"), F.lit(2).alias("of"),
        F.lit(9).alias("size"), F.lit("z").alias("own"), F.lit(4).alias("key"), F.lit(5).alias("edge"))
    got = mixing.mixed(docs).collect()
    assert {(r.doc_id, r.size, r.place, r["a.b"], r.of, r.own, r.key, r.edge) for r in got} == {
        (1, 3, "y", 1, 2, "z", 4, 5), (2, 1, "y", 1, 2, "z", 4, 5)}


def test_repeated_rows_are_spread_out(spark, rng):
    mix = mixing.mixed(docs_of(spark, texts(rng, 60, ["a", "b", "c"])))
    counts = Counter(r.doc_id for r in mixing.repeated(mix).collect())
    assert counts == Counter({r.doc_id: r.repeats for r in mix.collect() if r.repeats})


def test_bad_arguments(spark):
    with pytest.raises(ValueError):
        mixing.mixed(docs_of(spark, []), weights=())
    with pytest.raises(ValueError):
        mixing.mixed(docs_of(spark, []), epochs=0)

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from coordloom.llm import ann, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def nearest(rows, k):
    """Exact neighbours of the rows with an id divisible by 20."""
    out = []
    usable = [(i, v) for i, v in rows if i is not None and v is not None and len(v) == 8
              and None not in v and np.isfinite(v).all() and any(v)]
    for q, x in usable:
        if q % 20 == 0:
            best = {}
            for i, v in usable:
                if i != q:
                    best[i] = max(best.get(i, -np.inf), float(np.dot(x, v)))
            order = sorted(best, key=lambda i: (-best[i], i))[:k]
            out += [(q, r + 1, i) for r, i in enumerate(order)]
    return sorted(out)


def vectors(n, seed=1):
    rng = np.random.default_rng(seed)
    # Whole numbers: sums are exact and ties real.
    return [(i, [float(x) for x in rng.integers(-3, 4, 8)]) for i in range(n)]


def test_small_tables_are_searched_exactly(spark):
    rows = vectors(300) + [(301, None), (320, [0.0] * 8), (302, [float("nan")] * 8), (340, [1.0]),
                           (303, [None] * 8), (None, [1.0] * 8), (304, []), (305, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(df, F.col("vec_id") % 20 == 0, 20).collect())
    assert got == nearest(rows, 20)
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = ann.search(df.filter("vec_id < 5"), F.col("vec_id") % 20 == 0, 20)
    assert few.count() == 4


def test_ties_and_one_vector_that_most_rows_repeat(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_VECTORS", 64)
    monkeypatch.setattr(ann, "CELL_QUERIES", 8)
    rows = vectors(200) + [(i, [1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 1.0, 1.0]) for i in range(200, 700)]
    rows += [(21, [3.0] * 8), (699, rows[-1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(df, F.col("vec_id") % 20 == 0, 20).collect())
    assert got == nearest(rows, 20)


def test_routing_finds_nine_of_ten(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 256)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 20 == 0, 20).toPandas()
    assert (got.groupby("query_id").size() == 20).all()
    hits = 0
    for q, own in got.groupby("query_id"):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len(set(np.argsort(-scores)[:20]) & set(own.vec_id))
        assert np.allclose(own.score, [x[q] @ x[i] for i in own.vec_id], atol=1e-12)
    assert hits >= 0.9 * 20 * got.query_id.nunique()


def found(spark, x, k=20, **how):
    """Rows of each query, and the share of the true neighbours among them."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 20 == 0, k, **how).toPandas()
    hits = 0
    for q, own in got.groupby("query_id"):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += (own.score.to_numpy() >= np.sort(scores)[-k] - 1e-9).sum()
    queries = len(range(0, len(x), 20))
    return got.groupby("query_id").size().reindex(range(0, len(x), 20), fill_value=0), hits / k / queries


@pytest.mark.parametrize("lengths", ["spread", "two", "one_giant"])
def test_long_vectors_are_found(spark, monkeypatch, lengths):
    monkeypatch.setattr(ann, "PART_ROWS", 128)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 16))[rng.integers(0, 30, 4000)] + 0.3 * rng.normal(size=(4000, 16))
    x /= np.sqrt((x * x).sum(1))[:, None]
    x *= {"spread": np.exp(rng.normal(size=4000)), "two": rng.choice([1.0, 4.0], 4000, p=[0.7, 0.3]),
          "one_giant": np.where(np.arange(4000) == 7, 1e6, 1.0)}[lengths][:, None]
    sizes, recall = found(spark, x)
    assert (sizes == 20).all() and recall >= 0.9
    if lengths == "one_giant":
        assert found(spark, x, 1, sample=2000)[1] >= 0.9


def test_every_query_gets_k_rows_beside_many_copies(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 32)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 16))[rng.integers(0, 60, 3000)] + 0.1 * rng.normal(size=(3000, 16))
    x[rng.permutation(3000)[:1000]] = x[0]
    x[::100] = rng.normal(size=(30, 16))
    x /= np.sqrt((x * x).sum(1))[:, None]
    sizes, recall = found(spark, x, recall=0.0)  # one part a query is enough for this share
    assert (sizes == 20).all()


def test_copies_do_not_lower_the_visits():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 16))
    assert ann.fit(np.concatenate([x, np.repeat(x[:1], 1500, 0)]), 16, 20).visits == ann.fit(x, 16, 20).visits > 1


def test_visits_are_set_on_vectors_held_out(monkeypatch):
    x = np.random.default_rng(8).normal(size=(8192, 16))
    asked, fitted, neighbours, parts = [], [], ann._neighbours, ann.balanced_parts
    monkeypatch.setattr(ann, "_neighbours", lambda x, of, k: asked.append((len(x), len(of))) or neighbours(x, of, k))
    monkeypatch.setattr(ann, "balanced_parts", lambda graph, n: fitted.append(len(graph)) or parts(graph, n))
    ann.fit(x, 16, 20)
    assert asked[-1] == (8192, 1024) and fitted == [8192 - 1024]


def test_rows_that_repeat_an_id_do_not_swell_the_sample(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 256)
    x = np.random.default_rng(9).normal(size=(3000, 8))
    df = spark.createDataFrame([(min(i, 2000), v.tolist()) for i, v in enumerate(x)],
                               "vec_id long, embedding array<double>")
    sizes, fit = [], ann.fit
    monkeypatch.setattr(ann, "fit", lambda sample, *how: sizes.append(len(sample)) or fit(sample, *how))
    assert ann.search(df, F.col("vec_id") % 20 == 0, 20, sample=2200).count()
    assert ann.search(df, F.col("vec_id") % 20 == 0, 20, sample=1000).count()
    assert sizes[0] == 2001 and 800 <= sizes[1] <= 1200


def test_parts_are_balanced():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1000, 8)).astype(np.float32)
    graph = ann._neighbours(x, np.arange(1000), 8)
    part = ann.balanced_parts(graph, 8)
    assert np.bincount(part, minlength=8).tolist() == [125] * 8
    cut = (part[graph] != part[:, None]).mean()
    assert cut < 0.8 < 1 - 1 / 8


def fewest(lengths, capacity):
    """The least number of sequences, by trying all."""
    best = len(lengths)

    def place(k, room):
        nonlocal best
        if len(room) >= best:
            return
        if k == len(lengths):
            best = len(room)
            return
        for j in range(len(room)):
            if room[j] >= lengths[k] and room[j] not in room[:j]:
                room[j] -= lengths[k]
                place(k + 1, room)
                room[j] += lengths[k]
        place(k + 1, [*room, capacity - lengths[k]])

    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bin_completion_is_optimal_on_small_inputs(lengths):
    lengths = sorted(lengths, reverse=True)
    found = packing.bin_completion(Counter(lengths), 20)
    used = Counter()
    for pattern, n in found:
        assert sum(pattern) <= 20 and n > 0
        for k in pattern:
            used[k] += n
    assert used == Counter(lengths)
    best = fewest(lengths, 20)
    assert packing.lower_bound(Counter(lengths), 20) <= best
    assert sum(n for _, n in found) == best


def test_never_worse_than_best_fit():
    rng = random.Random(7)
    for _ in range(5):
        counts = Counter(rng.randrange(1, 2049) for _ in range(800))
        n = sum(k for _, k in packing.bin_completion(counts, 2048, 200))
        assert packing.lower_bound(counts, 2048) <= n <= sum(k for _, k in packing.best_fit(counts, 2048))
    with pytest.raises(ValueError):
        packing.bin_completion({3000: 1}, 2048)


def test_pieces_and_places(spark):
    rng = random.Random(9)
    texts = [None, "", "x", "same text here", "same text here", " ".join(
        f"w{rng.randrange(999)}" for _ in range(3000))] + [
        " ".join(f"v{rng.randrange(99)}" for _ in range(rng.randrange(1, 900))) for _ in range(40)]
    rows = [(k, t, 0) for k, t in enumerate(texts)] + [(3, texts[3], 0), (None, "y", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.packed(df, PATH).toPandas()
    library = Tokenizer.from_file(PATH)
    ids = {k: library.encode(t or "", add_special_tokens=False).ids + [0] for k, t, _ in rows}
    for (key, _), own in got.sort_values("piece").groupby(["doc_id", "ids_crc32"], dropna=False):
        whole = ids[None if np.isnan(key) else int(key)]
        for r in own.itertuples():
            part = np.array(whole[r.start:r.start + r.length], "<u4")
            assert zlib.crc32(part.tobytes()) == r.ids_crc32
    assert got.length.sum() == sum(len(ids[k]) for k, _, _ in rows)
    long = got[got.doc_id == 5].sort_values("piece")
    assert (long.length.iloc[1:] == 2048).all() and (long.start.to_numpy() == np.append(0, long.length.cumsum()[:-1])).all()
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum()[:-1]] and own.length.sum() <= 2048
    assert packing.packed(df.limit(0), PATH).count() == 0

"""Near duplicates, repeated passages and components against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from conftest_llm import prose, words_of

from coordloom.llm import jaccard, substring
from coordloom.llm.counters import cell_of, counted, ranks
from coordloom.llm.graph import components


def brute_components(rows):
    sets = []
    for _, text in rows:
        words = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    head = list(range(len(rows)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            head[find(j)] = find(i)
    groups: dict[int, list] = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    return sorted(((rows[k][0], len(sets[k]), min(
        (x for x in groups[find(k)] if x is not None), default=None)) for k in range(len(rows))), key=str)


def near_copies(rng, words, n, changes):
    out = []
    for _ in range(n):
        copy = list(words)
        for _ in range(changes):
            copy[rng.randrange(len(copy))] = f"new{rng.randrange(10 ** 6)}"
        out.append(" ".join(copy))
    return out


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies around the threshold, chains, small sets, shared passages."""
    rng = random.Random(3)
    texts = [None, "", " \n", "one", "One", "a b c d", "a b c d e", "A b c d e"]
    passage = prose(60, rng).split()
    for size in (5, 6, 7, 9, 10, 12, 13, 14, 18, 24, 40, 80, 200):
        words = prose(size, rng, 10 ** 6).split()
        for changes in (0, 0, 1, 1, 2, 3):
            texts += near_copies(rng, words, 2, changes)
        texts += [" ".join(words[:k]) for k in range(max(1, size - 4), size)]
        texts += [" ".join(words + words[:k]) for k in range(1, 4)]
    for _ in range(90):
        texts.append(" ".join(passage + prose(rng.randrange(10, 120), rng, 10 ** 6).split()))
    texts += near_copies(rng, passage + prose(100, rng, 10 ** 6).split(), 80, 2)
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts))


@pytest.mark.parametrize("order", ["counted", "none", "random"])
def test_components_equal_brute_force(spark, corpus, monkeypatch, order):
    """Whatever order the counters give."""
    if order != "counted":
        top = 1 if order == "none" else 256
        monkeypatch.setattr(jaccard, "ranks", lambda table: np.random.default_rng(1).integers(
            0, top, len(table)).astype(np.uint8))
    df = spark.createDataFrame([(k, t, k) for k, t in corpus], "doc_id long, text string, n long")
    got = sorted(map(tuple, jaccard.near_duplicates(df).collect()), key=str)
    assert got == brute_components(corpus)


@pytest.mark.parametrize("boundary", [0, 12])
def test_boundary_does_not_matter(spark, corpus, monkeypatch, boundary):
    monkeypatch.setattr(jaccard, "boundary", lambda own, held, percent: boundary)
    small = [(k, t) for k, t in corpus if len(t or "") < 150]
    df = spark.createDataFrame(small, "doc_id long, text string")
    got = sorted(map(tuple, jaccard.near_duplicates(df).collect()), key=str)
    assert got == brute_components(small)


def test_lists_and_blocks_of_any_length(spark, corpus, monkeypatch):
    """Most lists count as long, and clusters take many blocks."""
    monkeypatch.setattr(jaccard, "LONG_LIST", 2)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 9)
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    got = sorted(map(tuple, jaccard.near_duplicates(df).collect()), key=str)
    assert got == brute_components(corpus)


def test_boundary_follows_the_cost_of_lists(spark):
    """Short texts that differ in one of few words fill long lists; sets of their size then
    list subsets, and the result is the same."""
    rng = random.Random(12)
    texts = {" ".join([*"abcd", *(f"{c}{rng.randrange(3)}" for c in "efghij")]) for _ in range(400)}
    rows = list(enumerate(sorted(texts)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prefix = jaccard._shingled(df.selectExpr("doc_id AS id", "text"), jaccard._Pass(
        "prefix", common=spark.sparkContext.broadcast(np.zeros(1 << 20, np.uint8))))
    own = prefix.selectExpr("id AS node", "n", "tokens")
    held = jaccard._held(own.selectExpr("explode(tokens) AS token"))
    assert 6 <= jaccard.boundary(own, held)
    assert jaccard.boundary(own, held.limit(0)) == 0
    got = sorted(map(tuple, jaccard.near_duplicates(df).collect()), key=str)
    assert got == brute_components(rows)


def test_shared_counts_and_forests():
    rng = np.random.default_rng(2)
    for few in (1, 8):
        sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64) for _ in range(30)]
        for right in (None, sets[12:]):
            left = sets if right is None else sets[:12]
            got = jaccard.shared_counts(left, right)
            for i, x in enumerate(left):
                for j, y in enumerate(left if right is None else right):
                    if right is not None or i != j:
                        assert got[i, j] == len(np.intersect1d(x, y)), few
    for square in (True, False):
        links = rng.random((20, 20 if square else 14)) < 0.08
        links = links | links.T if square else links
        edges = jaccard.spanning(links, square)
        assert all(links[a, b] for a, b in edges)

        def groups(pairs):
            head = list(range(40))
            for a, b in pairs:
                a, b = int(a), int(b) if square else int(b) + 20
                old, new = head[b], head[a]
                head = [new if h == old else h for h in head]
            return [head.index(h) for h in head]
        assert groups(edges) == groups(np.argwhere(links)) and len(edges) < 34


def test_repeated_rows_null_keys_and_no_rows(spark):
    text = " ".join(f"x{k}" for k in range(30))
    rows = [(4, text), (4, text), (2, text + " y"), (4, "else"), (None, "else"), (None, None), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard.near_duplicates(df).collect()), key=str)
    assert got == sorted([(4, 26, 2), (4, 26, 2), (2, 27, 2), (4, 1, 4), (None, 1, 4),
                          (None, 0, None), (7, 0, 7)], key=str)
    assert jaccard.near_duplicates(df.limit(0)).count() == 0
    kept = sorted(map(tuple, jaccard.first_of_each(df).collect()), key=str)
    assert len(kept) == 4 and (2, text + " y") in kept and (7, None) in kept and (None, None) in kept
    assert ((4, "else") in kept) != ((None, "else") in kept)


def test_needed_is_the_threshold():
    for s in range(1, 60):
        for t in range(s, 60):
            least = next(c for c in range(s + t) if 100 * c >= 80 * (s + t - c))
            assert jaccard.needed(s, t) == least


def test_components_of_graphs(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    edges += [(1000, k) for k in range(1001, 1200)] + [(k, k + 1) for k in range(2000, 2060)]
    edges += [(5, 5), (None, 3)]
    head = {}

    def find(x):
        while head.setdefault(x, x) != x:
            x = head[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            head[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for k in head}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_removed(rows, window=35):
    counts = Counter()
    split = [words_of(t) for _, t in rows]
    for words in split:
        counts.update(tuple(words[k:k + window]) for k in range(len(words) - window + 1))
    out = []
    for (key, _), words in zip(rows, split):
        gone = set()
        for k in range(len(words) - window + 1):
            if counts[tuple(words[k:k + window])] > 1:
                gone.update(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((key, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def repeated_corpus():
    rng = random.Random(6)
    passages = [prose(n, rng, 10 ** 6) for n in (34, 35, 36, 50, 120)]
    rows = [(1, None), (2, ""), (3, "a " * 200), (4, "a b " * 40), (5, prose(34, rng)), (None, passages[4])]
    for k in range(60):
        parts = [prose(rng.randrange(0, 60), rng, 10 ** 6)]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), prose(rng.randrange(0, 30), rng, 10 ** 6)]
        rows.append((10 + k, "\n".join(parts)))
    whole = prose(150, rng, 10 ** 6).split()
    for k in range(30):
        copy = list(whole)
        copy[rng.randrange(150)] = f"new{k}"
        rows.append((100 + k, " ".join(copy)))
    return rows + [(100, rows[-1][1]), (7, "x" * 300 + " " + prose(400, rng))] + rows[-2:]


def test_removed_words_equal_brute_force(spark):
    rows = repeated_corpus()
    df = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, n_words string")
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest())
           for r in substring.without_repeats(df).collect()]
    assert sorted(got, key=str) == brute_removed(rows)
    assert substring.without_repeats(df.limit(0)).count() == 0


def test_cleaned_keeps_columns_and_untouched_texts(spark):
    text = " ".join(f"x{k}" for k in range(40))
    rows = [(1, "a  b\nc", 6, 1), (2, f"one {text} two", 0, 2), (3, text, 0, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, key int")
    got = sorted(map(tuple, substring.cleaned(df).collect()))
    assert got == [(1, "a  b\nc", 6, 1), (2, "one two", 7, 2), (3, "", 0, 3)]


def test_counters_cover_every_row(spark):
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 1 << 64, 500, np.uint64)
    df = spark.range(3000, numPartitions=7).select("id")
    table = counted(df, "id", lambda k: keys[: k % 500])
    want = np.zeros_like(table)
    for k in range(3000):
        np.add.at(want, cell_of(keys[: k % 500]), 1)
    assert (table == want).all()
    rank = ranks(table)
    assert rank[cell_of(keys[:1])[0]] > 0 and (rank[table == 0] == 0).all()
    assert not ranks(np.zeros(64, np.int64)).any()

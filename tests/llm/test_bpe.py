from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from coordloom.llm import bpe
from coordloom.llm.byte_bpe import byte_bpe
from coordloom.llm.token_ids import token_ids

PATH = public_tokenizers.path("byte_bpe_50k.json")


LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture
def library():
    return LIBRARY


def same(library, texts):
    for codec in (byte_bpe(PATH), token_ids(PATH)):
        got = [ids.tolist() for ids in codec.encode(texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_any_text(texts):
    same(LIBRARY, texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab's trevelm \n\t<|endofx> é1!", max_size=60), max_size=4))
def test_splitting(texts):
    same(LIBRARY, texts)


def test_edges(library):
    same(library, ["", " ", "  \n ", "a" * 3000, " " * 500 + "x", "<|endoftext|>", "a<|endoftext|>b c",
                   "'s't 're'LL", "é中\U0001F600 ́", "x\x1c\x85y"])


def test_latin_letters_are_split_alike(library):
    same(library, [f"x{chr(c)} {chr(c)}1{chr(c)}!{chr(c) * 3}" for c in range(0x250)])


def test_long_text_is_cut_at_word_starts(library, monkeypatch):
    monkeypatch.setattr("coordloom.llm.byte_bpe._CHARS_AT_ONCE", 50)
    rng = random.Random(2)
    text = "".join(rng.choice("ab  \n'st<|endoftext|>") for _ in range(3000))
    same(library, [text, text[:700]])


def test_equal_hashes_are_told_apart(library, monkeypatch):
    """The path for two words with one hash gives the same ids."""
    class Zero:
        def integers(self, low, high, size, dtype, endpoint):
            import numpy as np
            return np.zeros(size, np.uint64)

    monkeypatch.setattr("coordloom.llm.byte_bpe.np.random.default_rng", lambda seed: Zero())
    same(library, ["one two three two one", "four"])


def test_decode_matches(library):
    codec, rng = byte_bpe(PATH), random.Random(4)
    for _ in range(50):
        ids = [rng.randrange(50257) for _ in range(20)]
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_round_trip_rows(spark, library):
    rows = [(1, "Hi there", "x"), (1, "Hi there", "x"), (None, None, None), (3, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.round_trip(df, PATH).collect()
    assert len(got) == 4
    for row in got:
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(packed).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()
    assert bpe.round_trip(df.limit(0), PATH).count() == 0


def test_encode_then_decode(spark):
    df = spark.createDataFrame([(1, "some text é"), (2, None)], "doc_id long, text string")
    back = bpe.decode(bpe.encode(df, PATH), PATH, text="back").orderBy("doc_id").collect()
    assert [r.back for r in back] == ["some text é", ""]

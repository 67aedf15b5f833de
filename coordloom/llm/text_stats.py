"""Measurements of whole texts, in Arrow batches inside Spark tasks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documented choice: the window of words that counts as a repetition.
REPEAT_WORDS = 5

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_ROWS_AT_ONCE = 1024

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_chars", "n_upper", "n_lower", "n_digits", "n_marks", "n_lines", "n_distinct_words",
        "n_ends", "max_word", "n_same_next"]
# Words are parted by blank and 0x09-0x0D, which is what bytes.split() does.


def repeat_words(words: list, size: int = REPEAT_WORDS) -> int:
    """Words covered by windows of ``size`` words that occur more than once in the text."""
    windows = list(zip(*(words[k:] for k in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    again = np.fromiter((counts[w] > 1 for w in windows), np.int64, len(windows))
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:len(again)] += again
    edge[size:size + len(again)] -= again
    return int((np.cumsum(edge) > 0).sum())


def dup_lines(text: str) -> tuple[int, int]:
    """Lines that hold a word, and those of them equal to an earlier line."""
    lines = [x for x in text.encode().split(b"\n") if x.split(None, 1)]
    return len(lines), len(lines) - len(set(lines))


def measure(text: str | None) -> list[int]:
    """All measurements of one text, in the order ``BASE + MORE``; null counts as empty."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    solid = b"".join(words)
    chars = len(solid.decode())
    n_lines, duplicate = dup_lines(text)
    at = np.bincount(np.frombuffer(solid, np.uint8), minlength=256)
    upper, lower = int(at[65:91].sum()), int(at[97:123].sum())
    marks = sum(int(at[ord(c)]) for c in "!?,.;:-\"'()[]{}/\\@^_=+~`")
    return [
        n, chars, len(_SYMBOLS.findall(text)), duplicate, repeat_words(words),
        len(text), upper, lower, int(at[48:58].sum()), marks, n_lines, len(set(words)),
        sum(w[-1] in b".!?" for w in words), max(map(len, words), default=0),
        sum(map(eq, words, words[1:])),
    ]


def with_measures(df: DataFrame, text: str = "text", more: bool = False) -> DataFrame:
    """``df`` with its measurements as long columns; of equal names the new ones stay.

    Null and empty texts measure zero throughout. Texts are read whole; memory is that
    of the longest text. No shuffle.
    """
    names = BASE + (MORE if more else [])
    if text in names:
        raise ValueError(f"the text column cannot be named {text}")
    kept = df.drop(*[n for n in names if n in df.columns])
    schema = kept.withColumns({n: F.lit(None).cast("long") for n in names}).schema

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS_AT_ONCE):
                part = batch.slice(at, _ROWS_AT_ONCE)
                rows = np.array([
                    measure(t) if more else base(t) for t in part.column(text).to_pylist()
                ], np.int64).reshape(part.num_rows, len(names))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *(pa.array(c) for c in rows.T)], [*part.schema.names, *names])

    return kept.mapInArrow(measured, schema)


def base(text: str | None) -> list[int]:
    """The measurements ``BASE`` of one text."""
    text = text or ""
    words = text.encode().split()
    return [len(words), len(b"".join(words).decode()), len(_SYMBOLS.findall(text)),
            dup_lines(text)[1], repeat_words(words)]

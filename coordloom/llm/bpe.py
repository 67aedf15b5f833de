"""Byte-level BPE encoding and decoding of text columns, one pass without a shuffle."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coordloom.llm.byte_bpe import byte_bpe

_TEXTS_AT_ONCE = 512


def _extended(df: DataFrame, used: str, schema: str, work: Callable) -> DataFrame:
    """``df`` with columns computed from its column ``used`` in Arrow batches.

    ``work`` yields one tuple for each value. A column of ``df`` with the name of a
    new one is replaced.
    """
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    names = [name for name, _ in fields]
    kept = df.drop(*[n for n in names if n in df.columns and n != used])
    if used in names:
        raise ValueError(f"column {used} is read and cannot be replaced")
    full = kept.withColumns({n: F.lit(None).cast(t) for n, t in fields}).schema

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS_AT_ONCE):
                part = batch.slice(at, _TEXTS_AT_ONCE)
                rows = list(work(part.column(used).to_pylist()))
                made = [pa.array(c, types[n]) for n, c in zip(names, zip(*rows))]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, *names])

    types = {n: _ARROW[t] for n, t in fields}
    return kept.mapInArrow(extended, full)


_ARROW = {"array<int>": pa.list_(pa.int32()), "string": pa.string(), "long": pa.int64()}


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the token ids of a text column (null counts as empty).

    ``vocabulary`` is a byte-level BPE file in the JSON format of ``tokenizers``, at a
    path that every executor has. Special tokens are recognised in the text, none is
    added. Repeated rows stay, ids of an empty text are an empty array; a column named
    ``ids`` is replaced.
    """
    def work(texts):
        for found in byte_bpe(vocabulary).encode(texts):
            yield (found,)

    return _extended(df, text, f"{ids} array<int>", work)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``df`` with the text of its ids (null counts as none), special tokens included.

    Bytes that are not UTF-8 become U+FFFD. Ids outside the vocabulary raise. A column
    named ``text`` is replaced.
    """
    def work(rows):
        for found in rows:
            yield (byte_bpe(vocabulary).decode(found or []),)

    return _extended(df, ids, f"{text} string", work)


def round_trip(df: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``df`` with ``n_tokens`` and digests of its ids and of the text decoded from them.

    ``ids_sha256`` is taken over the ids as little-endian unsigned 32-bit integers,
    ``decoded_sha256`` over the decoded text in UTF-8. Encoding and decoding happen in
    one pass, so that no ids travel. A null text counts as empty; columns with these
    names are replaced.
    """
    def work(texts):
        codec = byte_bpe(vocabulary)
        for ids in codec.encode(texts):
            decoded = codec.decode(ids)
            yield (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(),
                   hashlib.sha256(decoded.encode()).hexdigest())

    return _extended(df, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", work)

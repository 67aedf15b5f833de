"""Token ids of texts where only the ids are wanted."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from coordloom.llm.byte_bpe import byte_bpe

#: Longer texts and other letters go to the own encoder: there the two libraries may follow
#: different versions of Unicode.
_LONGEST = 1 << 19
_OTHER = re.compile("[^\x00-ɏ]")
# Fixed value: the splitting pattern of this kind of vocabulary.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class TokenIds:
    """The ids that :class:`ByteBpe` gives, for Latin texts by a compiled library."""

    def __init__(self, path: str) -> None:
        import tiktoken

        self._own = byte_bpe(path)
        ranks = self._own.ranks()
        self._fast = ranks and tiktoken.Encoding(
            "own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=self._own.special)

    def encode(self, texts: list[str | None]):
        """Yields an array of ids for each text, in order; null counts as empty."""
        for text in texts:
            text = text or ""
            if not self._fast or len(text) > _LONGEST or _OTHER.search(text):
                yield next(iter(self._own.encode([text])))
            else:
                yield self._fast.encode_to_numpy(text, allowed_special="all").astype(np.uint32)


@lru_cache(2)
def token_ids(path: str) -> TokenIds:
    """The encoder of a file, read once in each Python worker."""
    return TokenIds(path)

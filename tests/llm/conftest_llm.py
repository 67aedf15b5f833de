"""Helpers of the tests in this folder."""

from __future__ import annotations

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text: str | None) -> list[str]:
    """Words by the plain pattern, as a brute-force test takes them."""
    return WORDS.findall(text or "")


def prose(n: int, rng: random.Random, vocabulary: int = 400) -> str:
    """A text of made words."""
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))

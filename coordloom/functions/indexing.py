"""Row-major index arithmetic as BIGINT column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F


def strides(dims: Sequence[int]) -> tuple[int, ...]:
    """How far the flat index moves for one step along each axis."""
    return tuple(math.prod(dims[k + 1:]) for k in range(len(dims)))


def div(index: Column, by: int) -> Column:
    """Whole-number division that stays in BIGINT."""
    return index if by == 1 else F.call_function("div", index, F.lit(by).cast("bigint"))


def unravel(index: Column, dims: Sequence[int]) -> list[Column]:
    """Coordinates of a flat index. The first axis needs no modulo."""
    quotients = [div(index, stride) for stride in strides(dims)]
    return quotients[:1] + [q % F.lit(d).cast("bigint") for q, d in zip(quotients[1:], dims[1:])]


def ravel(coords: Sequence[Column], dims: Sequence[int]) -> Column:
    """Flat index of coordinates; the inverse of :func:`unravel`."""
    terms = [c if s == 1 else c * F.lit(s).cast("bigint") for c, s in zip(coords, strides(dims))]
    return reduce(lambda a, b: a + b, terms)

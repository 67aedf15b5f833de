"""Column expressions on complex values held as two flat DOUBLE columns.

A real value has ``None`` in place of its imaginary column; arithmetic with it is
left out of the plan instead of multiplied by zero.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the text format and of the product modes.
SEPARATOR = "j"
COMPLEX = "complex"
COMPONENTWISE = "componentwise"


def parse_complex(text: Column) -> tuple[Column, Column]:
    """``'REjIM'`` as two doubles; malformed text raises under ANSI mode, and so does any
    other number of parts than two."""
    parts = F.split(text, SEPARATOR, -1)
    wrong = F.raise_error(F.concat(F.lit("no complex number: "), text)).cast("string")
    part = [F.when(text.isNull(), F.lit(None)).when(F.size(parts) == 2, parts[k])
            .otherwise(wrong).cast("double") for k in (0, 1)]
    return part[0], part[1]


def format_complex(re: Column, im: Column) -> Column:
    """Two doubles as ``'REjIM'``, exact on the way back."""
    return F.concat_ws(SEPARATOR, re.cast("string"), im.cast("string"))


def check_product(product: str) -> str:
    if product not in (COMPLEX, COMPONENTWISE):
        raise ValueError(f"product must be {COMPLEX!r} or {COMPONENTWISE!r}, got {product!r}")
    return product


def multiply(a: tuple[Column, Column | None], b: tuple[Column, Column | None],
             product: str = COMPLEX) -> tuple[Column, Column | None]:
    """Product of two values, true complex or part by part."""
    (ar, ai), (br, bi) = a, b
    if check_product(product) == COMPONENTWISE:
        return ar * br, ai * bi if ai is not None and bi is not None else None
    if ai is None and bi is None:
        return ar * br, None
    if ai is None:
        return ar * br, ar * bi
    if bi is None:
        return ar * br, ai * br
    return ar * br - ai * bi, ar * bi + ai * br


def magnitude_squared(re: Column, im: Column | None) -> Column:
    return re * re if im is None else re * re + im * im


def is_nonzero(re: Column, im: Column | None, eps: float = 0.0) -> Column:
    """True unless every part is within ``eps`` of zero; NaN counts as non-zero."""
    def test(part: Column) -> Column:
        return F.abs(part) > eps if eps else part != 0.0

    return test(re) if im is None else test(re) | test(im)

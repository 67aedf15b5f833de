"""Column expressions: complex values and row-major indices."""

from coordloom.functions.complex_numbers import (
    COMPLEX, COMPONENTWISE, format_complex, is_nonzero, magnitude_squared, multiply,
    parse_complex,
)
from coordloom.functions.exact import exact_sums
from coordloom.functions.indexing import div, ravel, strides, unravel

__all__ = [
    "COMPLEX", "COMPONENTWISE", "div", "exact_sums", "format_complex", "is_nonzero",
    "magnitude_squared", "multiply", "parse_complex", "ravel", "strides", "unravel",
]

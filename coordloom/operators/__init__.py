"""Operators on sparse matrices and arrays."""

from coordloom.operators.factors import axis_form, kron_factors
from coordloom.operators.lattice import marginals, sum_sets
from coordloom.operators.products import (
    AxisOperator, SplitOperator, apply_on_axis, apply_split, kron, matmul, prune_zeros, self_product,
)
from coordloom.operators.reductions import abs_square, norm
from coordloom.operators.reflection import densify, iterate_reflect, reflect
from coordloom.operators.tensors import FREE, marginal, ravel, renamed, reshape, sum_axis

__all__ = [
    "AxisOperator", "FREE", "SplitOperator", "abs_square", "apply_on_axis", "apply_split", "axis_form",
    "densify", "iterate_reflect", "kron", "kron_factors", "marginal", "marginals", "matmul", "norm", "prune_zeros", "ravel",
    "reflect", "renamed", "reshape", "self_product", "sum_axis", "sum_sets",
]

"""Sparse matrix and tensor algebra on Spark tables."""

from coordloom.table import CooTable, TensorTable, check_bounds

__all__ = ["CooTable", "TensorTable", "check_bounds"]

"""Where matrices come from and go to."""

from coordloom.sources.bridge import basis_vector, from_rows, measured_dims, to_coo
from coordloom.sources.columnar import (
    read_parquet, read_tensor_parquet, store_bucketed, store_split, write_parquet,
)
from coordloom.sources.coo_source import CooSource, head_dims, load_coo, register, save_coo
from coordloom.sources.coo_text import (
    LEFT, RIGHT, format_coo, parse_coo, read_coo, read_dims, read_headers, read_norm, read_tensor,
    write_coo, write_norm, write_tensor,
)
from coordloom.sources.generate import cyclic_shift, identity, uniform_vector

__all__ = [
    "CooSource", "LEFT", "RIGHT", "basis_vector", "cyclic_shift", "format_coo", "from_rows",
    "head_dims", "identity", "load_coo", "measured_dims", "parse_coo", "read_coo", "read_dims", "read_headers", "read_parquet",
    "read_norm", "read_tensor", "read_tensor_parquet", "register", "save_coo", "store_bucketed", "store_split", "to_coo", "uniform_vector", "write_coo",
    "write_norm", "write_parquet", "write_tensor",
]

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from coordloom.session import local_session  # noqa: E402
from coordloom.sources import from_rows  # noqa: E402

THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def no_broadcast(spark):
    """The plans for sides too large to broadcast."""
    before = spark.conf.get(THRESHOLD)
    spark.conf.set(THRESHOLD, "-1")
    yield
    spark.conf.set(THRESHOLD, before)


@pytest.fixture
def rng():
    return np.random.default_rng(7)


def dense(t) -> np.ndarray:
    """A small table as an array, repeated coordinates added up."""
    out = np.zeros(t.dims, dtype=complex)
    for r in t.entries().collect():
        out[r["row"], r["col"]] += complex(r["re"], r["im"])
    return out


def sparse(spark, array: np.ndarray):
    """The non-zeros of an array as a table."""
    array = np.asarray(array)
    rows = [(i, j, array[i, j].real, array[i, j].imag) for i, j in np.argwhere(array)]
    return from_rows(spark, rows, array.shape)


def random_sparse(rng, shape, share=0.4, complex_values=True) -> np.ndarray:
    """Small whole numbers, most of them zero, so that sums are exact."""
    def part():
        return rng.integers(-4, 5, shape).astype(float)

    values = part() + (1j * part() if complex_values else 0)
    return np.where(rng.random(shape) < share, values, 0)

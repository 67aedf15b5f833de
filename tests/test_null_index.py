"""A NULL index raises in every plan, whatever the join makes of NULL keys."""

from __future__ import annotations

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from coordloom.operators import (
    apply_on_axis, iterate_reflect, kron, matmul, norm, reflect, self_product,
)
from coordloom.plans import chain_apply
from coordloom.sources import from_rows, identity, store_bucketed, to_coo, write_parquet
from coordloom.table import CooTable

# Where both sides of a join fail, Spark wraps both errors into one that has no Python class.
RAISED = (PySparkException, Py4JJavaError)
ENTRIES = [[(0, 0, 1.0), (0, None, 1.0)], [(1, 1, 1.0), (None, 1, 1.0)], [(None, None, 2.0)]]


def broken(spark, rows, checked):
    df = spark.createDataFrame(rows, "row long, col long, re double")
    return to_coo(df, "row", "col", "re", dims=(2, 2)) if checked else CooTable(df, (2, 2))


def good(spark):
    return from_rows(spark, [(0, 0, 1), (1, 0, 2), (1, 1, 3)], (2, 2))


PLANS = {
    "broadcast right": lambda s, t: matmul(t, good(s)),
    "broadcast left": lambda s, t: matmul(good(s), t),
    "identity": lambda s, t: matmul(t, identity(s, 2)),
    "cells right": lambda s, t: matmul(t, good(s), plan="cells"),
    "cells left": lambda s, t: matmul(good(s), t, plan="cells"),
    "hot cells": lambda s, t: matmul(t, good(s), plan="cells", hot=1),
    "hot cells left": lambda s, t: matmul(good(s), t, plan="cells", hot=1),
    "in place, moved": lambda s, t: matmul(store_bucketed(good(s)), t.merged(), plan="in_place"),
    "in place, bucketed": lambda s, t: matmul(store_bucketed(t), good(s), plan="in_place"),
    "symmetric": lambda s, t: self_product(t),
    "symmetric transposed": lambda s, t: self_product(t.transpose()),
    "kron": lambda s, t: kron(t, good(s)),
    "kron blocks": lambda s, t: kron(good(s), t, plan="blocks"),
    "axis": lambda s, t: apply_on_axis(t, from_rows(s, [(k, 0, 1) for k in range(6)], (6, 1)), (3, 2), 2),
    "axis cells": lambda s, t: apply_on_axis(t, from_rows(s, [(1, 0, 1)], (6, 1)), (3, 2), 2, plan="cells"),
    "chain": lambda s, t: chain_apply([t], good(s), 2).state,
}


@pytest.mark.parametrize("checked", [True, False])
@pytest.mark.parametrize("rows", ENTRIES)
@pytest.mark.parametrize("plan", list(PLANS))
def test_products_raise(spark, plan, rows, checked):
    with pytest.raises(RAISED, match="an index is NULL"):
        PLANS[plan](spark, broken(spark, rows, checked)).df.collect()


@pytest.mark.parametrize("plan", ["broadcast right", "broadcast left", "symmetric", "axis"])
def test_products_raise_without_broadcast(spark, no_broadcast, plan):
    for rows in ENTRIES:
        with pytest.raises(RAISED, match="an index is NULL"):
            PLANS[plan](spark, broken(spark, rows, False)).df.collect()


@pytest.mark.parametrize("flips", [None, [0], [None]])
def test_reflections_raise(spark, flips):
    entries = [(0, 0, 1.0)] if flips == [None] else [(0, 0, 1.0), (None, 0, 1.0)]
    v = CooTable(spark.createDataFrame(entries, "row long, col long, re double"), (4, 1))
    flipped = None if flips is None else spark.createDataFrame([(f,) for f in flips], "row long")
    for result in (reflect(v, flipped), iterate_reflect(v, 3, flipped)):
        with pytest.raises(RAISED, match="an index is NULL"):
            result.df.collect()


def test_norm_and_files_raise(spark, tmp_path):
    for rows in ENTRIES:
        with pytest.raises(RAISED):
            norm(broken(spark, rows, True)).collect()
        with pytest.raises(RAISED):
            write_parquet(broken(spark, rows, False), str(tmp_path / "m"))


def test_outside_raises_the_same_error_everywhere(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (5, 1, 1.0)], "row long, col long, re double")
    t = to_coo(df, "row", "col", "re", dims=(2, 2))
    for plan in ("broadcast right", "cells right", "symmetric", "kron"):
        with pytest.raises(RAISED):
            PLANS[plan](spark, t).df.collect()
    assert matmul(to_coo(df.where(F.col("row") < 2), "row", "col", "re", dims=(2, 2)), good(spark)).count() == 1

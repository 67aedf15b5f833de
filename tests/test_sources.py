from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import dense, random_sparse, sparse
from coordloom import session
from coordloom.functions import parse_complex
from coordloom.operators import matmul, norm, reshape, sum_axis
from coordloom.session import broadcast_entries, cut, new_folder, shared_folder
from coordloom.sources import (
    LEFT, RIGHT, basis_vector, cyclic_shift, from_rows, identity, read_coo, read_dims,
    read_norm, read_parquet, read_tensor, read_tensor_parquet, to_coo, uniform_vector, write_coo,
    write_norm, write_parquet, write_tensor,
)
from coordloom.table import CooTable, check_bounds


def folder(path, **files: str) -> str:
    path.mkdir()
    for name, text in files.items():
        (path / name.replace("__", "-")).write_text(text)
    return str(path)


def lines(path: str) -> list[str]:
    from pathlib import Path

    parts = sorted(p for p in Path(path).iterdir() if p.name.startswith("part"))
    return [line for p in parts for line in p.read_text().splitlines()]


# -- text -------------------------------------------------------------------


def test_text_round_trip(spark, rng, tmp_path):
    a = random_sparse(rng, (7, 5)) * 0.1
    path = str(tmp_path / "m")
    for _ in range(2):  # the second write replaces the first
        write_coo(sparse(spark, a), path, LEFT)
    got = read_coo(spark, path, LEFT)
    assert got.dims == (7, 5)
    assert np.array_equal(dense(got), a)
    assert read_coo(spark, path, RIGHT, dims=(7, 5)).count() == 0


def test_header_in_the_last_part_and_noise(spark, tmp_path):
    path = folder(
        tmp_path / "m",
        part__r__00000="A,0,0,1.5j0\n\n   \nB,0,0,9j9\n A,1,1,7j7\n#B,9,9\n",
        part__r__00001="X,5\nA,2,1,-0.25j-3e-2\n#A,3,2",
        _SUCCESS="",
    )
    t = read_coo(spark, path, LEFT)
    assert t.dims == (3, 2)
    assert sorted(tuple(r) for r in t.df.collect()) == [(0, 0, 1.5, 0.0), (2, 1, -0.25, -0.03)]
    assert read_dims(spark, path, RIGHT) == (9, 9)


def test_both_operands_in_one_folder(spark, tmp_path):
    path = folder(tmp_path / "m", part__0="#A,1,2\nA,0,0,2j1\nA,0,1,1j0\n",
                  part__1="#B,2,1\nB,0,0,3j0\nB,1,0,0j1\n")
    got = matmul(read_coo(spark, path, LEFT), read_coo(spark, path, RIGHT))
    assert dense(got)[0, 0] == (2 + 1j) * 3 + 1j


def test_two_folders(spark, tmp_path):
    a = folder(tmp_path / "a", part__0="#A,2,2\nA,0,0,1j0\n")
    b = folder(tmp_path / "b", part__0="A,1,1,1j0\n")
    assert np.array_equal(dense(read_coo(spark, [a, b], LEFT)), np.eye(2))


@pytest.mark.parametrize("line", ["A,0,0", "A,1,0,0,1j0", "A,x,0,1j0", "A,0,0,1", "A,0,0,ajb"])
def test_malformed_lines_raise(spark, tmp_path, line):
    path = folder(tmp_path / "m", part__0=f"#A,2,2\n{line}\n")
    with pytest.raises(PySparkException):
        read_coo(spark, path, LEFT).df.collect()


def test_wrong_field_count_raises_under_pruning(spark, tmp_path):
    path = folder(tmp_path / "m", part__0="#A,2,2\nA,1,0,0,1j0\n")
    with pytest.raises(PySparkException):
        read_coo(spark, path, LEFT).count()


def test_headers_are_checked(spark, tmp_path):
    none = folder(tmp_path / "a", part__0="A,0,0,1j0\n")
    two = folder(tmp_path / "b", part__0="#A,2,2\n", part__1="#A,3,3\n")
    for path in (none, two):
        with pytest.raises(ValueError):
            read_coo(spark, path, LEFT)
    with pytest.raises(ValueError):
        read_coo(spark, none, "C", dims=(1, 1))


def test_ordered_files_have_the_header_first(spark, rng, tmp_path):
    a = random_sparse(rng, (12, 12), 0.5)
    path = str(tmp_path / "m")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_coo(sparse(spark, a), path, RIGHT, ordered=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    text = lines(path)
    assert text[0] == "#B,12,12"
    places = [tuple(int(x) for x in line.split(",")[1:3]) for line in text[1:]]
    assert places == sorted(places) and len(places) == np.count_nonzero(a)
    assert len([p for p in (tmp_path / "m").iterdir() if p.name.startswith("part")]) > 1
    assert np.array_equal(dense(read_coo(spark, path, RIGHT)), a)


def test_tensor_text(spark, rng, tmp_path):
    v = random_sparse(rng, (24, 1), 0.6, complex_values=False)
    t = reshape(sparse(spark, v), (2, 3, 4))
    path = str(tmp_path / "t")
    write_tensor(t, path, RIGHT, ordered=True)
    assert lines(path)[0] == "#B,2,3,4"
    got = read_tensor(spark, path, RIGHT)
    assert got.dims == (2, 3, 4)
    want = {tuple(r) for r in sum_axis(t, [2]).df.collect()}
    assert {tuple(r) for r in sum_axis(got, [2]).df.collect()} == want
    complex_path = str(tmp_path / "c")
    write_tensor(reshape(from_rows(spark, [(1, 0, 1, 2)], (4, 1)), (2, 2)), complex_path, LEFT)
    assert sorted(lines(complex_path)) == ["#A,2,2", "A,0,1,1.0j2.0"]


def test_norm_text(spark, tmp_path):
    write_norm(norm(from_rows(spark, [(0, 0, 3, 4)], (1, 1))), str(tmp_path / "n"))
    assert lines(str(tmp_path / "n")) == ["5.0"]


# -- tables -----------------------------------------------------------------


def test_to_coo_adds_repeats_and_measures(spark):
    df = spark.createDataFrame([(0, 3, 1.0), (0, 3, 2.0), (5, 0, 4.0)], "a int, b int, x double")
    t = to_coo(df, "a", "b", "x")
    assert t.dims == (6, 4) and t.unique
    assert sorted(tuple(r) for r in t.df.collect()) == [(0, 3, 3.0), (5, 0, 4.0)]
    with pytest.raises(ValueError):
        to_coo(df.where("a > 9"), "a", "b", "x")


@pytest.mark.parametrize("row", [(None, 0, 1.0), (0, None, 1.0), (0, 0, None)])
def test_null_raises(spark, row):
    df = spark.createDataFrame([row], "a int, b int, x double")
    t = to_coo(df, "a", "b", "x", dims=(2, 2))
    with pytest.raises(PySparkException):
        t.df.collect()
    with pytest.raises(PySparkException):
        matmul(t, identity(spark, 2)).df.collect()


def test_parquet_keeps_dimensions(spark, rng, tmp_path):
    a = random_sparse(rng, (9, 4), 0.3)
    path = str(tmp_path / "m")
    write_parquet(sparse(spark, a), path)
    got = read_parquet(spark, path)
    assert (got.dims, got.unique, got.full, got.stored) == ((9, 4), True, False, True)
    assert np.array_equal(dense(got), a)
    plain = str(tmp_path / "p")
    sparse(spark, a).df.write.parquet(plain)
    with pytest.raises(ValueError):
        read_parquet(spark, plain)
    assert read_parquet(spark, plain, (9, 4)).dims == (9, 4)


def test_tensor_parquet(spark, rng, tmp_path):
    v = random_sparse(rng, (24, 1), 0.6, complex_values=False)
    t = sum_axis(reshape(sparse(spark, v), (2, 3, 4)), [2])
    path = str(tmp_path / "t")
    write_parquet(t, path, clustered=True)
    got = read_tensor_parquet(spark, path)
    assert (got.dims, got.axes, got.values) == ((2, 4), ("i1", "i3"), ("val",))
    assert {tuple(r) for r in got.df.collect()} == {tuple(r) for r in t.df.collect()}
    write_parquet(sparse(spark, v * 1j), str(tmp_path / "m"))
    assert read_tensor_parquet(spark, str(tmp_path / "m")).values == ("re", "im")
    spark.range(3).write.parquet(str(tmp_path / "x"))
    with pytest.raises(ValueError):
        read_tensor_parquet(spark, str(tmp_path / "x"))


def test_clustered_files_follow_the_index(spark, tmp_path):
    rows = [(i % 50, i // 50, 1.0) for i in range(1000)] + [(7, j, 1.0) for j in range(20, 500)]
    t = from_rows(spark, rows, (50, 500))
    path = str(tmp_path / "m")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_parquet(t, path, clustered=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    name = F.col("_metadata.file_name")
    at = F.struct("row", "col")
    parts = (spark.read.parquet(path).groupBy(name.alias("file"))
             .agg(F.min(at).alias("lo"), F.max(at).alias("hi")).orderBy("lo").collect())
    assert len(parts) > 1
    assert all(a["hi"] < b["lo"] for a, b in zip(parts, parts[1:]))
    assert read_parquet(spark, path).count() == t.count()


def test_out_of_bounds_entries_are_reported(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (2, 0, 1.0), (0, 2, 1.0), (-1, 0, 1.0)],
                               "row long, col long, re double")
    assert check_bounds(CooTable(df, (2, 2))).count() == 3
    t = reshape(CooTable(df.where("row >= 0"), (2, 1)), (2, 1))
    assert [r["i1"] for r in check_bounds(t).collect()] == [2]


def test_table_columns_are_checked(spark):
    with pytest.raises(ValueError):
        CooTable(spark.range(1), (1, 1))


# -- generators -------------------------------------------------------------


def test_generators(spark):
    assert np.array_equal(dense(identity(spark, 4)), np.eye(4))
    assert np.array_equal(dense(uniform_vector(spark, 4)), np.full((4, 1), 0.5))
    v = basis_vector(spark, (2, 3), {(1, 2): 0.5j, (0, 1): -2})
    assert np.array_equal(dense(v).T, [[0, -2, 0, 0, 0, 0.5j]])
    for coords in ((2, 0), (0,), (0, -1)):
        with pytest.raises(ValueError):
            basis_vector(spark, (2, 3), {coords: 1})


def test_cyclic_shift(spark):
    assert np.array_equal(dense(cyclic_shift(spark, (5,))), np.roll(np.eye(5), 1, axis=1))
    assert np.array_equal(dense(cyclic_shift(spark, (5,), (-7,))), np.roll(np.eye(5), -7, axis=1))


def test_cyclic_shift_on_two_axes(spark):
    x = np.arange(12.0).reshape(3, 4)
    got = dense(cyclic_shift(spark, (3, 4), (1, -2))) @ x.ravel()
    assert np.array_equal(got.real, np.roll(x, (-1, 2), axis=(0, 1)).ravel())
    with pytest.raises(ValueError):
        cyclic_shift(spark, (3, 4), (1,))


# -- indices outside, own sources, stored data --------------------------------


@pytest.mark.parametrize("key", [True, False])
@pytest.mark.parametrize("row", [(2, 0), (0, 2), (-1, 0), (None, 0), (0, None)])
def test_an_index_outside_or_null_raises(spark, row, key):
    df = spark.createDataFrame([(*row, 1.0), (1, 1, 2.0)], "r long, c long, v double")
    t = to_coo(df, "r", "c", "v", dims=(2, 2), key=key)
    with pytest.raises(Exception, match="NULL or outside"):
        t.df.select("re").collect()
    plain = CooTable(df.select(F.col("r").alias("row"), F.col("c").alias("col"), F.col("v").alias("re")), (2, 2))
    assert check_bounds(plain).count() == 1


def test_text_outside_given_dims_raises(spark, tmp_path):
    path = str(tmp_path / "m")
    write_coo(from_rows(spark, [(3, 0, 1)], (4, 1)), path, LEFT)
    assert read_coo(spark, path, LEFT).count() == 1
    with pytest.raises(Exception, match="outside"):
        read_coo(spark, path, LEFT, (3, 1)).count()


@pytest.mark.parametrize("kind", ["text", "ordered", "tensor", "parquet", "norm"])
def test_writing_onto_the_own_source_is_refused(spark, tmp_path, kind):
    path = str(tmp_path / "m")
    t = from_rows(spark, [(0, 0, 1), (1, 0, 2)], (2, 1))
    if kind in ("text", "ordered"):
        write_coo(t, path, LEFT)
        again = lambda: write_coo(read_coo(spark, path, LEFT), path, LEFT, kind == "ordered")
        left = lambda: read_coo(spark, path, LEFT).count()
    elif kind == "tensor":
        write_tensor(reshape(t, (2,)), path, LEFT)
        again = lambda: write_tensor(read_tensor(spark, path, LEFT), path, LEFT)
        left = lambda: read_tensor(spark, path, LEFT).df.count()
    elif kind == "parquet":
        write_parquet(t, path)
        again = lambda: write_parquet(read_parquet(spark, path), path)
        left = lambda: read_parquet(spark, path).count()
    else:
        write_norm(spark.createDataFrame([(1.5,), (2.5,)], "norm double"), path)
        again = lambda: write_norm(read_norm(spark, path), path)
        left = lambda: read_norm(spark, path).count()
    with pytest.raises(ValueError, match="another folder"):
        again()
    assert left() == 2


@pytest.mark.parametrize("text", ["1j2j3", "1", "", "j", "1jx"])
def test_malformed_complex_numbers_raise(spark, text):
    re, im = parse_complex(F.col("t"))
    with pytest.raises(Exception):
        spark.createDataFrame([(text,)], "t string").select(re, im).collect()


# -- session ----------------------------------------------------------------


def test_cut_reads_back_the_same_rows(spark):
    df = spark.range(100).select("id", F.col("id").cast("double").alias("x"))
    again = cut(df)
    assert again.schema.simpleString() == df.schema.simpleString()
    assert again.exceptAll(df).count() == 0 and again.count() == 100
    assert "FileScan" in again._jdf.queryExecution().executedPlan().toString()
    assert new_folder(spark, "x").startswith(shared_folder(spark))


def test_broadcast_threshold_is_the_sessions(spark, no_broadcast):
    key = "spark.sql.autoBroadcastJoinThreshold"
    assert broadcast_entries(spark) == 0
    spark.conf.set(key, "64MB")
    assert broadcast_entries(spark) == 1 << 20


def test_stored_tables_are_written_by_small_tasks(spark, monkeypatch):
    """Files and shuffle partitions of a job that stores a table are cut small, and only of that."""
    sizes = {name: spark.conf.get(name) for name in session._TASK_SIZES}
    monkeypatch.setattr(session, "TASK_BYTES", 4_000)
    df = spark.range(40_000).groupBy((F.col("id") * 7 % 30_011).alias("k")).count()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")
    try:
        stored = session.cut(df)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
    assert len(stored.inputFiles()) == 8 and stored.count() == 30_011
    assert {name: spark.conf.get(name) for name in sizes} == sizes
    for name in sizes:
        spark.conf.set(name, "2000b")
    try:
        with session.small_tasks(spark):
            assert all(spark.conf.get(name) == "2000b" for name in sizes)
    finally:
        for name, text in sizes.items():
            spark.conf.set(name, text)

"""The text format as a data source."""

from __future__ import annotations

import random

import numpy as np
import pytest
from conftest import dense, random_sparse, sparse
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from coordloom.sources import LEFT, RIGHT, head_dims, load_coo, read_coo, register, save_coo, write_coo
from coordloom.sources.coo_source import HEAD_BYTES, CooReader, CooWriter, Split, _blocks, parsed


def folder(path, **files) -> str:
    path.mkdir()
    for name, text in files.items():
        (path / name.replace("__", "-")).write_text(text)
    return str(path)


def test_round_trip_and_the_other_reader(spark, rng, tmp_path):
    a, path = random_sparse(rng, (9, 7), 0.6) + 1e-7, str(tmp_path / "m")
    for _ in range(2):
        save_coo(sparse(spark, a), path, RIGHT)
    for read in (load_coo, read_coo):
        got = read(spark, path, RIGHT)
        assert got.dims == (9, 7) and np.array_equal(dense(got), a)
    write_coo(sparse(spark, a), str(tmp_path / "n"), LEFT)
    assert np.array_equal(dense(load_coo(spark, str(tmp_path / "n"), LEFT)), a)
    assert not [p for p in (tmp_path / "m").iterdir() if p.name.startswith("_temporary")]


def test_noise_and_a_header_elsewhere(spark, tmp_path):
    path = folder(
        tmp_path / "m",
        part__r__00000="A,0,0,1.5j0\n\n   \nB,0,0,9j9\n A,1,1,7j7\n#B,9,9\r\n",
        part__r__00001="X,5\nA,2,1,-0.25j-3e-2\n#A,3,2", _SUCCESS="A,1,1,5j5\n")
    got = load_coo(spark, path, LEFT)
    assert head_dims(path, LEFT)[0] is None and got.dims == (3, 2)
    assert sorted(map(tuple, got.df.collect())) == [(0, 0, 1.5, 0.0), (2, 1, -0.25, -0.03)]
    assert load_coo(spark, path, RIGHT).df.collect()[0][2:] == (9.0, 9.0)


@pytest.mark.parametrize("line", ["A,0,0", "A,1,0,0,1j0", "A,x,0,1j0", "A,0,0,1", "A,0,0,ajb", "A,2,0,1j0"])
def test_malformed_lines_and_indices_outside_raise(spark, tmp_path, line):
    path = folder(tmp_path / "m", part__0=f"#A,2,2\n{line}\n")
    with pytest.raises(PySparkException):
        load_coo(spark, path, LEFT).df.collect()


@pytest.mark.parametrize("end", ["\n", ""])
def test_lines_belong_to_one_split(tmp_path, monkeypatch, end):
    rng = random.Random(1)
    lines = [f"A,{k},{rng.randrange(10 ** rng.randint(1, 6))},1j0" for k in range(60)]
    data = ("\n".join(lines) + end).encode()
    (tmp_path / "f").write_bytes(data)
    monkeypatch.setattr("coordloom.sources.coo_source.BLOCK_BYTES", 17)
    from pyarrow import fs
    for size in (1, 2, 13, 14, 50, 200, 10_000):
        got = []
        for at in range(0, len(data), size):
            with fs.LocalFileSystem().open_input_file(str(tmp_path / "f")) as stream:
                split = Split("", at, min(at + size, len(data)))
                got += [row for block in _blocks(stream, split) for row in parsed(block, "A").column("row").to_pylist()]
        assert got == list(range(60)), size


def test_splits_of_any_size_read_the_same(spark, rng, tmp_path):
    a, path = random_sparse(rng, (20, 20), 0.5), str(tmp_path / "m")
    save_coo(sparse(spark, a), path, LEFT)
    register(spark)
    rows = {tuple(r) for r in load_coo(spark, path, LEFT).df.collect()}
    small = spark.read.format("coo").option("role", LEFT).option("splitBytes", 97).load(path)
    assert {tuple(r) for r in small.collect()} == rows and small.count() == len(rows)


def test_dimensions_read_the_head_of_one_file(spark, tmp_path):
    df = spark.range(200_000).select(F.col("id").alias("row"), (F.col("id") % 7).alias("col"),
                                     F.rand(1).alias("re"))
    from coordloom.table import CooTable
    path = str(tmp_path / "m")
    save_coo(CooTable(df, (200_000, 7)), path, LEFT)
    dims, read = head_dims(path, LEFT)
    size = sum(p.stat().st_size for p in (tmp_path / "m").iterdir())
    assert dims == (200_000, 7) and read <= HEAD_BYTES < size / 100


def test_rows_are_filtered_in_the_reader_and_files_skipped(spark, tmp_path):
    from coordloom.table import CooTable
    df = spark.range(0, 1000, 1, 10).select(F.col("id").alias("row"), F.lit(0).cast("long").alias("col"),
                                            F.lit(1.0).alias("re"))
    path = str(tmp_path / "m")
    save_coo(CooTable(df, (1000, 1)), path, LEFT)
    t, part = load_coo(spark, path, LEFT), load_coo(spark, path, LEFT, rows=(250, 310))
    assert sorted(r.row for r in part.df.collect()) == list(range(250, 310)) and part.dims == t.dims
    # The header's file, and the two with these rows.
    assert part.df.rdd.getNumPartitions() == 3 and t.df.rdd.getNumPartitions() == 11
    assert load_coo(spark, path, LEFT, rows=(5000, 6000)).count() == 0
    # Uses of one table do not get into each other's way.
    assert [r.row for r in t.df.where("row = 999").collect()] == [999]
    assert t.df.where("row <= 3 AND col = 0").count() == 4 and t.count() == 1000
    assert t.df.where("row > 10 OR col = 5").count() == 989


def test_a_failed_write_leaves_the_target_as_it_was(spark, tmp_path):
    path = str(tmp_path / "m")
    a = np.eye(3)
    save_coo(sparse(spark, a), path, LEFT)
    register(spark)
    bad = spark.range(50).select(F.col("id").alias("row"), F.lit(0).cast("long").alias("col"), F.when(
        F.col("id") == 49, F.raise_error(F.lit("broken")).cast("double")).otherwise(1.0).alias("re"), F.lit(0.0).alias("im"))
    with pytest.raises(PySparkException):
        bad.write.format("coo").option("dims", "50,1").mode("overwrite").save(path)
    assert np.array_equal(dense(load_coo(spark, path, LEFT)), a)
    with pytest.raises(PySparkException):
        sparse(spark, a).entries().write.format("coo").option("dims", "3,3").mode("append").save(path)
    with pytest.raises(ValueError):
        CooWriter({"path": path}, True)


def test_null_values_are_not_written(spark, tmp_path):
    register(spark)
    df = spark.sql("SELECT 0L AS row, CAST(NULL AS BIGINT) AS col, 1.0D AS re, 0.0D AS im")
    with pytest.raises(PySparkException):
        df.write.format("coo").option("dims", "1,1").mode("overwrite").save(str(tmp_path / "m"))


def test_reader_options(tmp_path):
    path = folder(tmp_path / "m", part__0="#A,2,2\nA,0,0,1j0\n")
    reader = CooReader({"path": path})
    assert [(s.start, s.stop) for s in reader.partitions()] == [(0, 17)]
    with pytest.raises(ValueError):
        CooReader({"path": path, "role": "C"})

"""Matrices and arrays as Parquet, the normal storage, and as bucketed tables.

Dimensions travel in the column metadata of the index columns, which Spark keeps in
the Parquet schema: reading them back takes a look into the footers and no scan.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from coordloom.operators.products import SplitOperator
from coordloom.session import cut, discard, new_folder, note_table, refuse_own_source
from coordloom.table import HOT_ENTRIES, CooTable, TensorTable, check_dims, present, within

_SIZE = "size"
_UNIQUE = "unique"
_FULL = "full"


def _with_facts(t: CooTable | TensorTable) -> DataFrame:
    """The table with its facts in the metadata of the index columns, which hold no NULL."""
    if isinstance(t, TensorTable):
        axes, facts = t.axes, {}
    else:
        axes, facts = ("row", "col"), {_UNIQUE: t.unique, _FULL: t.full}
    index = [present(a).alias(a, metadata={_SIZE: d, **facts}) for a, d in zip(axes, t.dims)]
    return t.df.select(*index, *t.values)


def write_parquet(t: CooTable | TensorTable, path: str, clustered: bool = False) -> None:
    """Write the table, its dimensions and what is known about it.

    ``clustered`` lays the entries out in index order, for tables that are read by
    ranges of leading indices: such a read then skips files and row groups. Ranges
    are cut over all index columns, so one heavy row does not fill a single file.
    """
    df = _with_facts(t)
    if clustered:
        index = ["row", "col"] if isinstance(t, CooTable) else list(t.axes)
        df = df.repartitionByRange(*index).sortWithinPartitions(*index)
    refuse_own_source(df, path)
    df.write.mode("overwrite").parquet(path)


def read_parquet(spark: SparkSession, path: str,
                 dims: tuple[int, int] | None = None) -> CooTable:
    """A matrix from Parquet files; ``dims`` is needed for files of other origin."""
    df = spark.read.parquet(path)
    rows, cols = (df.schema[c].metadata for c in ("row", "col"))
    if dims is None:
        if _SIZE not in rows or _SIZE not in cols:
            raise ValueError("the files carry no dimensions; give dims")
        dims = (rows[_SIZE], cols[_SIZE])
    else:
        df = within(df, ("row", "col"), check_dims(dims))
    return CooTable(df, dims, unique=bool(rows.get(_UNIQUE)), full=bool(rows.get(_FULL)),
                    stored=True)


def read_tensor_parquet(spark: SparkSession, path: str) -> TensorTable:
    """An array from Parquet files written by :func:`write_parquet`."""
    df = spark.read.parquet(path)
    sizes = {f.name: f.metadata[_SIZE] for f in df.schema if _SIZE in f.metadata}
    values = tuple(c for c in df.columns if c not in sizes)
    if values not in (("val",), ("re", "im")):
        raise ValueError(f"the files hold no array: columns {df.columns}")
    return TensorTable(df, tuple(sizes.values()), tuple(sizes), values)


def heaviest(t: CooTable, by: str) -> int:
    """Entries of the commonest index; runs a job."""
    return t.df.groupBy(by).count().agg(F.max("count")).first()[0] or 0


def store_bucketed(t: CooTable, by: str = "col", buckets: int | None = None,
                   hot: int = HOT_ENTRIES) -> CooTable:
    """Store an operator that many products will read, bucketed by its join index.

    A product with a state too large to broadcast then moves only the state. A
    bucket cannot be split at run time, so if the commonest index has more than ``hot``
    entries the matrix is stored unbucketed and products fall back to the plan that cuts
    hot keys. The files are registered in the session catalog as an external table.
    """
    if by not in ("row", "col"):
        raise ValueError(f"bucket by 'row' or 'col', not {by!r}")
    spark = t.df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    t = t.merged()
    stored = t.store()
    # Fewer entries than make a hot index need no look at the indices.
    top = stored.counted if stored.counted is not None and stored.counted <= hot else heaviest(stored, by)
    if top > hot:
        return stored
    bucketed = _bucketed(stored, by, n, top)
    if stored is not t:
        discard(spark, stored.path)
    return bucketed


def _bucketed(stored: CooTable, by: str, n: int, top: int) -> CooTable:
    spark = stored.df.sparkSession
    name = f"coordloom_{uuid.uuid4().hex}"
    path = new_folder(spark, "bucketed")
    # One task per bucket, so that each bucket is one file.
    (_with_facts(stored).repartition(n, by).write.format("parquet").bucketBy(n, by)
     .option("path", path).saveAsTable(name))
    note_table(name)
    return replace(stored, df=spark.table(name), bucketed=by, heaviest=top, path=path)


def store_split(t: CooTable, buckets: int | None = None, hot: int = HOT_ENTRIES) -> CooTable | SplitOperator:
    """Store an operator for many products, its hot columns apart.

    Columns of at most ``hot`` entries are bucketed as by :func:`store_bucketed`. Entries of
    the others are written in ranges of rows and columns, so that no file holds a whole hot
    column. A product moves the state alone, see :func:`~coordloom.operators.apply_split`.
    Without a hot column this is :func:`store_bucketed`.
    """
    spark = t.df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    t = t.merged()
    stored = t.store()
    keys = cut(stored.df.groupBy("col").count().where(F.col("count") > hot).select("col"))
    count = keys.count()
    if not count:
        return store_bucketed(stored, "col", buckets, hot)
    light = replace(stored, df=stored.df.join(keys, "col", "left_anti").select("row", "col", *stored.values),
                    counted=None, full=False)
    heavy = replace(stored, df=stored.df.join(keys, "col", "left_semi").select("row", "col", *stored.values)
                    .repartitionByRange(n, "row", "col"), stored=False, counted=None, full=False)
    split = SplitOperator(_bucketed(light, "col", n, hot), heavy.store(), keys, count)
    if stored is not t:
        discard(spark, stored.path)
    return split

"""Session helpers: a default session, the shared folder, lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid
import warnings
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"
_BROADCAST_THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"

_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20,
          "g": 1 << 30, "gb": 1 << 30, "t": 1 << 40, "tb": 1 << 40}

# Of files that a task reads and of shuffle partitions that are put together for one.
TASK_BYTES = 16 << 20
_TASK_SIZES = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")

# Four 8-byte columns plus the row overhead of Spark's hashed relation.
_BYTES_PER_ENTRY = 64


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark.

    Products multiply rows, so partitions that look small in bytes are still worth
    a core each: coalescing stops earlier than by default.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("coordloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local-mode session, where driver and executors are one machine, may
    go without the setting; it then gets a fresh temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get(_CHECKPOINT_DIR, None) or context.getCheckpointDir()
    local = context.master.startswith(("local[", "local-cluster")) or context.master == "local"
    if folder is not None and not local and folder.startswith("file:"):
        warnings.warn(f"{_CHECKPOINT_DIR}={folder} must be a mount that all executors share")
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError(
                f"set {_CHECKPOINT_DIR} to a folder all executors share; "
                "stored tables must survive the loss of a machine"
            )
        context.setCheckpointDir(tempfile.mkdtemp(prefix="coordloom-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


@dataclass
class Scratch:
    """What operators stored while it was open; :meth:`release` deletes all of it."""

    spark: SparkSession
    folders: list[str] = field(default_factory=list)
    tables: list[str] = field(default_factory=list)

    def release(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        for path in self.folders:
            discard(self.spark, path)
        self.tables.clear()
        self.folders.clear()


_open: list[Scratch] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Notes every folder and table that operators store within the block.

    Results stay readable after the block, until ``release()`` of what it gives.
    """
    noted = Scratch(spark)
    _open.append(noted)
    try:
        yield noted
    finally:
        _open.remove(noted)


def note_table(name: str) -> None:
    """Have the open scratch blocks drop this catalog table."""
    for noted in _open:
        noted.tables.append(name)


def new_folder(spark: SparkSession, purpose: str) -> str:
    """An unused path below the shared folder."""
    path = f"{shared_folder(spark)}/coordloom/{purpose}-{uuid.uuid4().hex}"
    for noted in _open:
        noted.folders.append(path)
    return path


def refuse_own_source(df: DataFrame, path: str) -> None:
    """Raise if replacing ``path`` would delete files that ``df`` still has to read."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toUri()
    place = whole.getPath().rstrip("/") + "/"
    for file in df.inputFiles():
        source = spark._jvm.java.net.URI(file)
        if source.getScheme() == whole.getScheme() and f"{source.getPath()}/".startswith(place):
            raise ValueError(f"{path} holds files that the table to be written is read from; "
                             "write to another folder")


@contextmanager
def small_tasks(spark: SparkSession) -> Iterator[None]:
    """Has the jobs of the block read files, and put shuffle partitions together, by at most
    ``TASK_BYTES``: sums of many keys take ten times the bytes of their packed rows."""
    before = {name: spark.conf.get(name) for name in _TASK_SIZES}
    try:
        for name, text in before.items():
            if _bytes(name, text) > TASK_BYTES:
                spark.conf.set(name, f"{TASK_BYTES}b")
        yield
    finally:
        for name, text in before.items():
            spark.conf.set(name, text)


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the files.

    The plan after the cut is a plain Parquet scan: short lineage, true size
    statistics for the optimizer, nothing to recompute when an executor is lost.
    """
    spark = df.sparkSession
    path = path or new_folder(spark, "cut")
    with small_tasks(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`new_folder` that no plan reads any more."""
    if not path.startswith(f"{shared_folder(spark)}/coordloom/"):
        raise ValueError(f"{path} is not a folder of this library")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def local_table(spark: SparkSession, rows: Sequence[Sequence], **types: pa.DataType) -> DataFrame:
    """A few rows as a local relation, which needs no Python worker to be read."""
    columns = zip(*rows) if rows else ((),) * len(types)
    return spark.createDataFrame(pa.table(
        {name: pa.array(c, t) for (name, t), c in zip(types.items(), columns)}))


def _bytes(name: str, text: str) -> int:
    """A size setting in bytes."""
    text = text.strip().lower()
    match = re.fullmatch(r"(-?\d+)\s*([a-z]*)", text)
    if match is None or match.group(2) not in _UNITS:
        raise ValueError(f"cannot read {name}={text!r}")
    return int(match.group(1)) * _UNITS[match.group(2)]


def broadcast_entries(spark: SparkSession) -> int:
    """How many matrix entries may be broadcast under the session's threshold."""
    return max(_bytes(_BROADCAST_THRESHOLD, spark.conf.get(_BROADCAST_THRESHOLD)), 0) // _BYTES_PER_ENTRY

"""The coordinate text format as a data source: ``spark.read.format("coo")``.

Files are read in byte ranges, parsed a block at a time as Arrow columns. A range of rows
given as an option is applied there, and files whose names tell that they have none of them
are skipped. (Filters are not pushed down: Spark 4.1 keeps one reader for all uses of a
loaded DataFrame, and one use's filter would hold for the others.) Files are written beside
the target and moved there when all tasks are through.

Driver and tasks open the files with ``pyarrow.fs``: paths it knows (a folder all machines
mount, S3, GCS, HDFS with its client library). For others use ``read_coo`` and ``write_coo``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from coordloom.sources.coo_text import DELIMITER, HEADER, check_role, read_dims
from coordloom.table import CooTable, check_dims

FORMAT = "coo"
SCHEMA = "row long, col long, re double, im double"
#: Bytes of a split, of a block that is parsed at once, and of a file's head.
SPLIT_BYTES, BLOCK_BYTES, HEAD_BYTES = 64 << 20, 4 << 20, 4 << 10
_NAME = re.compile(r"part-\d+-[0-9a-f]+-rows-(-?\d+)-(-?\d+)\.txt$")
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _opened(path: str) -> tuple:
    """The file system of a path and the place on it."""
    from pyarrow import fs  # starts threads, so only where files are opened

    return fs.FileSystem.from_uri(path)


def _files(path: str) -> list:
    """The data files of a folder in the order of their names, or the file itself."""
    from pyarrow import fs

    system, place = _opened(path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.File:
        return [info]
    found = [i for i in system.get_file_info(fs.FileSelector(place)) if i.type == fs.FileType.File]
    return sorted((i for i in found if i.base_name[0] not in "_."), key=lambda i: i.path)


def head_dims(path: str, role: str) -> tuple[tuple[int, ...] | None, int]:
    """The dimensions from the first line of a file, and how many bytes were read for them.

    Files are looked at in the order of their names until one begins with the header of
    ``role``; of each its head is read. None if no file begins so.
    """
    system, _ = _opened(path)
    start, read = f"{HEADER}{check_role(role)}{DELIMITER}".encode(), 0
    for info in _files(path):
        with system.open_input_stream(info.path) as stream:
            head = stream.read(HEAD_BYTES)
        read += len(head)
        if head.startswith(start):
            line = head.split(b"\n", 1)[0].decode().strip()
            return tuple(int(d) for d in line.split(DELIMITER)[1:]), read
    return None, read


@dataclass
class Split(InputPartition):
    """A byte range of a file: the lines that begin within it."""

    path: str
    start: int
    stop: int


def _blocks(stream: pa.NativeFile, split: Split) -> Iterator[bytes]:
    """Whole lines that begin within the split, some megabytes at a time."""
    at, rest = split.start, b""
    if at:  # a line that begins before belongs to the split before
        stream.seek(at - 1)
        at -= 1
        skipped = False
    else:
        skipped = True
    while True:
        block = stream.read(BLOCK_BYTES)
        if not block:
            break
        if not skipped:
            end = block.find(b"\n")
            if end < 0:
                at += len(block)
                continue
            at, block, skipped = at + end + 1, block[end + 1:], True
        if at >= split.stop and not rest:
            return
        at += len(block)
        rest += block
        if at >= split.stop:  # the last line may go on behind the end of the split
            over = at - split.stop
            tail = rest.find(b"\n", max(0, len(rest) - over - 1))
            if tail >= 0:
                yield rest[:tail + 1]
                return
            continue
        end = rest.rfind(b"\n") + 1
        if end:
            yield rest[:end]
            rest = rest[end:]
    if rest:
        yield rest


def parsed(block: bytes, role: str) -> pa.RecordBatch:
    """The entries of the lines tagged ``role``; malformed ones raise."""
    lines = pa.array(block.split(b"\n"), pa.binary()).cast(pa.string())
    lines = pc.utf8_rtrim(lines, characters="\r")
    lines = lines.filter(pc.starts_with(lines, role + DELIMITER))
    fields = pc.split_pattern(lines, DELIMITER)
    wrong = pc.not_equal(pc.list_value_length(fields), 4)
    if pc.any(wrong).as_py():
        raise ValueError(f"expected 4 fields in line: {lines.filter(wrong)[0].as_py()}")
    row, col, value = (pc.utf8_trim_whitespace(pc.list_element(fields, k)) for k in (1, 2, 3))
    parts = pc.split_pattern(value, "j")
    wrong = pc.not_equal(pc.list_value_length(parts), 2)
    if pc.any(wrong).as_py():
        raise ValueError(f"no complex number: {value.filter(wrong)[0].as_py()}")
    re_, im = (pc.utf8_trim_whitespace(pc.list_element(parts, k)).cast(pa.float64()) for k in (0, 1))
    return pa.RecordBatch.from_arrays(
        [row.cast(pa.int64()), col.cast(pa.int64()), re_, im], ["row", "col", "re", "im"])


class CooReader(DataSourceReader):
    """Entries of one role within a range of rows."""

    def __init__(self, options: dict) -> None:
        self.path, self.role = options["path"], check_role(options.get("role", "A"))
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        dims = options.get("dims")
        self.dims = check_dims(dims.split(DELIMITER)) if dims else None
        self.low, self.high = int(options.get("minrow", _LEAST)), int(options.get("maxrow", _MOST))

    def _wanted(self, name: str) -> bool:
        told = _NAME.search(name)
        return told is None or int(told[1]) <= self.high and int(told[2]) >= self.low

    def partitions(self) -> list[Split]:
        return [Split(i.path, at, min(at + self.split_bytes, i.size)) for i in _files(self.path)
                if self._wanted(i.base_name) for at in range(0, i.size, self.split_bytes)] or [Split("", 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if not partition.stop:
            return
        system, _ = _opened(self.path)
        with system.open_input_file(partition.path) as stream:
            for block in _blocks(stream, partition):
                batch = parsed(block, self.role)
                if self.dims is not None and batch.num_rows:
                    self._check(batch)
                if (self.low, self.high) != (_LEAST, _MOST):
                    row = batch.column("row")
                    batch = batch.filter(pc.and_(pc.greater_equal(row, pa.scalar(self.low, pa.int64())),
                                                 pc.less_equal(row, pa.scalar(self.high, pa.int64()))))
                if batch.num_rows:
                    yield batch

    def _check(self, batch: pa.RecordBatch) -> None:
        for name, size in zip(("row", "col"), self.dims):
            ends = pc.min_max(batch.column(name)).as_py()
            if ends["min"] < 0 or ends["max"] >= size:
                raise ValueError(f"an index is outside {self.dims}: {name} from {ends['min']} to {ends['max']}")


@dataclass
class Written(WriterCommitMessage):
    """A file of a task under its temporary name."""

    temporary: str
    name: str


class CooWriter(DataSourceArrowWriter):
    """One file for each task, moved to the target when all are written."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.role = options["path"].rstrip("/"), check_role(options.get("role", "A"))
        if "dims" not in options:
            raise ValueError("writing takes the option dims, such as 15000,1000")
        self.dims, self.overwrite = check_dims(options["dims"].split(DELIMITER)), overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written | None:
        system, place = _opened(self.path)
        task = TaskContext.get()
        temporary = f"{place}/_temporary-{self.job}/{task.taskAttemptId()}"
        low, high, stream = _MOST, _LEAST, None
        for batch in iterator:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            row, col, re_ = (batch.column(names.index(n)) for n in ("row", "col", "re"))
            im = batch.column(names.index("im")) if "im" in names else pa.array([0.0] * batch.num_rows)
            if row.null_count or col.null_count or re_.null_count or im.null_count:
                raise ValueError("an index or a value is NULL")
            ends = pc.min_max(row).as_py()
            low, high = min(low, ends["min"]), max(high, ends["max"])
            texts = [c.cast(pa.string()) for c in (row, col)]
            value = pc.binary_join_element_wise(re_.cast(pa.string()), im.cast(pa.string()), "j")
            lines = pc.binary_join_element_wise(pa.scalar(self.role), *texts, value, DELIMITER)
            if stream is None:
                system.create_dir(f"{place}/_temporary-{self.job}", recursive=True)
                stream = system.open_output_stream(temporary)
            stream.write("\n".join(lines.to_pylist()).encode() + b"\n")
        if stream is None:
            return None
        stream.close()
        return Written(temporary, f"part-{task.partitionId() + 1:05d}-{self.job[:8]}-rows-{low}-{high}.txt")

    def commit(self, messages: list[Written | None]) -> None:
        system, place = _opened(self.path)
        system.create_dir(place, recursive=True)
        old = _files(self.path) if self.overwrite else []
        if not self.overwrite and _files(self.path):
            raise ValueError(f"{self.path} holds files; write with mode overwrite")
        for info in old:
            system.delete_file(info.path)
        with system.open_output_stream(f"{place}/part-00000-{self.job[:8]}.txt") as stream:
            stream.write((HEADER + DELIMITER.join([self.role, *map(str, self.dims)]) + "\n").encode())
        for m in messages:
            if m is not None:
                system.move(m.temporary, f"{place}/{m.name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, place = _opened(self.path)
        left = f"{place}/_temporary-{self.job}"
        if system.get_file_info(left).type == fs.FileType.Directory:
            system.delete_dir(left)


class CooSource(DataSource):
    """Options: ``path``, ``role`` (A or B), ``dims`` (for writing; checked if given for
    reading), ``minRow`` and ``maxRow`` (both included), ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> CooReader:
        return CooReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> CooWriter:
        return CooWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(CooSource)


def load_coo(spark: SparkSession, path: str, role: str, dims: tuple[int, int] | None = None,
             rows: tuple[int, int] | None = None) -> CooTable:
    """The matrix tagged ``role`` by the data source, or its ``rows`` from one up to another.

    Its dimensions come from the head of the first file that begins with its header; a header
    elsewhere is found by a scan of the text.
    """
    register(spark)
    dims = dims or head_dims(path, role)[0] or read_dims(spark, path, role)
    reader = spark.read.format(FORMAT).option("role", role).option("dims", DELIMITER.join(map(str, dims)))
    if rows is not None:
        reader = reader.option("minRow", rows[0]).option("maxRow", rows[1] - 1)
    return CooTable(reader.load(path), dims)


def save_coo(t: CooTable, path: str, role: str) -> None:
    """Write the matrix by the data source, replacing what ``path`` holds once all is written."""
    register(t.df.sparkSession)
    t.entries().write.format(FORMAT).option("role", role).option(
        "dims", DELIMITER.join(map(str, t.dims))).mode("overwrite").save(path)

"""Import from and export to the coordinate text format.

One entry per line, ``TAG,row,col,REjIM`` for a matrix and ``TAG,i1,..,in,VALUE``
for an array; one header line ``#TAG,d1,..,dn`` in any of the files.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from coordloom.functions import format_complex, parse_complex
from coordloom.session import refuse_own_source
from coordloom.table import CooTable, TensorTable, axis_names, within

# Fixed values of the text format.
LEFT = "A"
RIGHT = "B"
HEADER = "#"
DELIMITER = ","

# Characters of a file's head, and files opened at once for them.
HEAD_CHARS, HEADS_AT_ONCE = 512, 8

Paths = str | Sequence[str]


def check_role(role: str) -> str:
    if role not in (LEFT, RIGHT):
        raise ValueError(f"role must be {LEFT!r} or {RIGHT!r}, got {role!r}")
    return role


def _lines(spark: SparkSession, paths: Paths) -> DataFrame:
    return spark.read.text([paths] if isinstance(paths, str) else list(paths))


def _fields(lines: DataFrame, role: str, n: int) -> DataFrame:
    """The fields ``f`` of the lines tagged ``role``.

    Headers, other tags, blank lines and lines that begin with a space are
    skipped. A line of this tag with a wrong number of fields raises, as part of
    the filter, so that column pruning cannot lose the check.
    """
    fields = F.split("value", DELIMITER, -1)
    wrong = F.raise_error(F.concat(
        F.lit(f"expected {n} fields in line: "), F.col("value"))).cast("boolean")
    mine = F.col("value").startswith(role + DELIMITER)
    return lines.where(F.when(mine, (F.size(fields) == n) | wrong).otherwise(False)).select(
        fields.alias("f"))


def parse_coo(lines: DataFrame, role: str) -> DataFrame:
    """Text lines (column ``value``) as ``row, col, re, im``."""
    f = F.col("f")
    re, im = parse_complex(f[3])
    return _fields(lines, check_role(role), 4).select(
        f[1].cast("bigint").alias("row"), f[2].cast("bigint").alias("col"),
        re.alias("re"), im.alias("im"))


def format_coo(t: CooTable, role: str) -> DataFrame:
    """The entries as text lines, ``value``, with their index, without the header."""
    value = format_complex(F.col("re"), F.col("im"))
    line = F.concat_ws(DELIMITER, F.lit(check_role(role)), "row", "col", value)
    return t.entries().select("row", "col", line.alias("value"))


def _header(spark: SparkSession, role: str, dims: Sequence[int]) -> DataFrame:
    line = HEADER + DELIMITER.join([role, *(str(d) for d in dims)])
    return spark.range(1).select(F.lit(line).alias("value"))


def _first_lines(spark: SparkSession, paths: Paths) -> list[str]:
    """The first line of every file, at most ``HEAD_CHARS`` characters of it.

    Any file system that Spark reads will do; files are opened a few at a time.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = []
    for path in [paths] if isinstance(paths, str) else paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        system = target.getFileSystem(conf)
        for found in system.globStatus(target) or []:
            inside = system.listStatus(found.getPath()) if found.isDirectory() else [found]
            files += [(system, f.getPath()) for f in inside
                      if f.isFile() and not f.getPath().getName().startswith(("_", "."))]

    def head(file: tuple) -> str:
        system, place = file
        stream = system.open(place)
        try:
            reader = jvm.java.io.InputStreamReader(stream, "UTF-8")
            buffer = spark.sparkContext._gateway.new_array(jvm.char, HEAD_CHARS)
            n = reader.read(buffer)
            return jvm.java.lang.String.valueOf(buffer, 0, n).split("\n", 1)[0].strip() if n > 0 else ""
        finally:
            stream.close()

    with ThreadPoolExecutor(HEADS_AT_ONCE) as pool:
        return list(pool.map(head, files))


def read_headers(spark: SparkSession, paths: Paths,
                 roles: Sequence[str] = (LEFT, RIGHT)) -> dict[str, tuple[int, ...]]:
    """The dimensions of every role that has a header line.

    Headers that begin a file are found by the first lines alone. Only if one of ``roles`` has
    none there the text is scanned, since a header may stand anywhere; a reader given ``dims``
    needs neither.
    """
    start = tuple(f"{HEADER}{role}{DELIMITER}" for role in (LEFT, RIGHT))
    found = {line for line in _first_lines(spark, paths) if line.startswith(start)}
    if not all(any(line.startswith(f"{HEADER}{role}{DELIMITER}") for line in found) for role in roles):
        rows = _lines(spark, paths).where(F.col("value").rlike(f"^{HEADER}[{LEFT}{RIGHT}]{DELIMITER}")).select(
            F.trim("value").alias("value")).distinct().limit(3).collect()
        found = {row["value"] for row in rows}
    headers: dict[str, tuple[int, ...]] = {}
    for role, *dims in (line.removeprefix(HEADER).split(DELIMITER) for line in sorted(found)):
        if role in headers:
            raise ValueError(f"more than one header for role {role!r} under {paths}")
        headers[role] = tuple(int(d) for d in dims)
    return headers


def read_dims(spark: SparkSession, paths: Paths, role: str) -> tuple[int, ...]:
    """The dimensions from the header line of ``role``; see :func:`read_headers`."""
    headers = read_headers(spark, paths, [check_role(role)])
    if role not in headers:
        raise ValueError(f"no header for role {role!r} under {paths}")
    return headers[role]


def read_coo(spark: SparkSession, paths: Paths, role: str,
             dims: tuple[int, int] | None = None) -> CooTable:
    """The matrix tagged ``role`` in one or more folders of text files."""
    dims = dims or read_dims(spark, paths, role)
    return CooTable(within(parse_coo(_lines(spark, paths), role), ("row", "col"), dims), dims)


def _write(header: DataFrame, body: DataFrame, index: Sequence[str], path: str,
           ordered: bool) -> None:
    """Header and entries (``value`` and the index columns) as text files."""
    lines = header.unionByName(body.select("value"))
    if ordered:
        # A header sorts before all entries, as its index is NULL.
        lines = header.unionByName(body, allowMissingColumns=True).orderBy(
            *(F.col(c).asc_nulls_first() for c in index)).select("value")
    refuse_own_source(lines, path)
    lines.write.mode("overwrite").text(path)


def write_coo(t: CooTable, path: str, role: str, ordered: bool = False) -> None:
    """Write the matrix with its header under the tag ``role``, replacing ``path``.

    ``ordered`` sorts the lines over all files by row and column, the header first:
    the files strung together by name are one file in order, though each is written
    by a task of its own.
    """
    header = _header(t.df.sparkSession, check_role(role), t.dims)
    _write(header, format_coo(t, role), ["row", "col"], path, ordered)


def _tensor_value(t: TensorTable) -> Column:
    if t.values == ("val",):
        return F.col("val").cast("string")
    return format_complex(F.col("re"), F.col("im"))


def write_tensor(t: TensorTable, path: str, role: str, ordered: bool = False) -> None:
    """Write an array with its header; see :func:`write_coo`."""
    line = F.concat_ws(DELIMITER, F.lit(check_role(role)), *t.axes, _tensor_value(t))
    body = t.df.select(*t.axes, line.alias("value"))
    _write(_header(t.df.sparkSession, role, t.dims), body, t.axes, path, ordered)


def read_tensor(spark: SparkSession, paths: Paths, role: str,
                dims: Sequence[int] | None = None) -> TensorTable:
    """A real array of any rank from text files."""
    dims = tuple(dims) if dims is not None else read_dims(spark, paths, role)
    axes = axis_names(len(dims))
    f = F.col("f")
    df = _fields(_lines(spark, paths), check_role(role), len(dims) + 2).select(
        *(f[k].cast("bigint").alias(a) for k, a in enumerate(axes, start=1)),
        f[len(dims) + 1].cast("double").alias("val"))
    return TensorTable(within(df, axes, dims), dims, axes)


def write_norm(norm: DataFrame, path: str) -> None:
    """The one number of a norm table as text."""
    refuse_own_source(norm, path)
    norm.select(F.col("norm").cast("string")).write.mode("overwrite").text(path)


def read_norm(spark: SparkSession, path: str) -> DataFrame:
    """The number that :func:`write_norm` wrote."""
    return spark.read.schema("value string").text(path).select(
        F.col("value").cast("double").alias("norm"))

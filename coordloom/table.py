"""The two table kinds: sparse matrices and n-dimensional arrays."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from coordloom.session import cut, new_folder


# Entries of one key that a single cell of a join may hold on either side.
HOT_ENTRIES = 65_536


def check_dims(dims: Iterable[int]) -> tuple[int, ...]:
    """The shape of an array: sizes of at least 1, whose flat index is a BIGINT."""
    out = tuple(int(d) for d in dims)
    if any(d < 1 for d in out):
        raise ValueError(f"dimensions must be at least 1, got {out}")
    if math.prod(out) >= 1 << 63:
        raise ValueError(f"the index space of {out} does not fit a BIGINT")
    return out


@dataclass(frozen=True)
class CooTable:
    """A sparse matrix: one row per entry, absent coordinates are zero.

    ``df`` has ``row BIGINT, col BIGINT, re DOUBLE`` and, if complex, ``im
    DOUBLE``. A real table has no ``im`` column, so no operator spends work on
    it. A vector is a matrix of one column. The flags are facts about the data
    that let an operator choose its plan without running a job:

    * ``unique``: no coordinate occurs twice;
    * ``full``: every coordinate occurs exactly once;
    * ``at_most``: a proven upper bound on the number of entries;
    * ``counted``: the number of entries, noted as they were written;
    * ``stored``: ``df`` is a plain scan or a generated range, cheap to read twice;
    * ``bucketed``: the files are bucketed by this column, whose commonest index has
      ``heaviest`` entries;
    * ``path``: the folder that :meth:`store` wrote.
    """

    df: DataFrame
    dims: tuple[int, int]
    unique: bool = False
    full: bool = False
    at_most: int | None = None
    counted: int | None = None
    stored: bool = False
    bucketed: str | None = None
    heaviest: int = 0
    path: str | None = None

    def __post_init__(self) -> None:
        if len(self.dims) != 2:
            raise ValueError(f"a matrix has two dimensions, got {self.dims}")
        dims = tuple(n for d in self.dims for n in check_dims([d]))
        missing = {"row", "col", "re"} - set(self.df.columns)
        if missing:
            raise ValueError(f"a matrix table needs the columns {sorted(missing)}")
        object.__setattr__(self, "dims", dims)
        object.__setattr__(self, "unique", self.unique or self.full)

    @property
    def is_complex(self) -> bool:
        return "im" in self.df.columns

    @property
    def bound(self) -> int | None:
        """Most entries the table can hold, if that is known."""
        known = [n for n in (self.at_most, self.counted) if n is not None]
        if self.unique:
            known.append(self.dims[0] * self.dims[1])
        return min(known, default=None)

    @property
    def values(self) -> list[str]:
        return ["re", "im"] if self.is_complex else ["re"]

    def entries(self) -> DataFrame:
        """``row, col, re, im``, with a literal zero ``im`` on a real table."""
        im = F.col("im") if self.is_complex else F.lit(0.0).alias("im")
        return self.df.select("row", "col", "re", im)

    def count(self) -> int:
        """Number of entries; runs a job unless it was noted as they were written."""
        return self.df.count() if self.counted is None else self.counted

    def transpose(self) -> CooTable:
        df = self.df.select(F.col("col").alias("row"), F.col("row").alias("col"),
                            *self.values)
        bucketed = {"row": "col", "col": "row"}.get(self.bucketed)
        return replace(self, df=df, dims=self.dims[::-1], bucketed=bucketed)

    def merged(self) -> CooTable:
        """The same matrix with repeated coordinates added up."""
        if self.unique:
            return self
        df = self.df.groupBy("row", "col").agg(*(F.sum(v).alias(v) for v in self.values))
        return CooTable(df, self.dims, unique=True, at_most=self.bound)

    def store(self) -> CooTable:
        """Write the entries once to the shared folder and read them from there.

        They are counted on the way, which no later operator has to do then. Indices outside
        the dimensions raise, as the shape is a fact that plans build on.
        """
        if self.stored:
            return self
        path = new_folder(self.df.sparkSession, "matrix")
        seen = Observation()
        df = cut(self.df.observe(seen, F.count(F.lit(1)).alias("entries"), *(
            f(c).alias(f"{c}_{n}") for c in ("row", "col") for n, f in (("least", F.min), ("most", F.max)))), path)
        facts = seen.get
        for axis, size in zip(("row", "col"), self.dims):
            if facts["entries"] and facts[f"{axis}_least"] is not None and not (
                    0 <= facts[f"{axis}_least"] and facts[f"{axis}_most"] < size):
                raise ValueError(f"an index is outside {self.dims}: {axis} from "
                                 f"{facts[f'{axis}_least']} to {facts[f'{axis}_most']}")
        return replace(self, df=df, stored=True, path=path, counted=facts["entries"])


@dataclass(frozen=True)
class TensorTable:
    """An n-dimensional sparse array.

    ``axes`` are the index columns in order; operators take axis *numbers*,
    counted from 1, that refer to this order. The value is ``val``, or ``re`` and
    ``im`` for a reshaped complex vector. ``flat`` keeps the vector an array was
    reshaped from, so that a position on leading axes can become a row range.
    """

    df: DataFrame
    dims: tuple[int, ...]
    axes: tuple[str, ...]
    values: tuple[str, ...] = ("val",)
    flat: DataFrame | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "dims", check_dims(self.dims))
        if len(self.dims) != len(self.axes):
            raise ValueError(f"{len(self.axes)} axes but dimensions {self.dims}")

    @property
    def rank(self) -> int:
        return len(self.dims)


def axis_names(rank: int) -> tuple[str, ...]:
    return tuple(f"i{k}" for k in range(1, rank + 1))


def present(name: str) -> Column:
    """An index column, where a NULL raises.

    A join takes only keys that are not NULL, and the optimizer filters by that in the scan,
    before or beside any other filter: a check next to the key would never see the row. So
    the check is part of the key.
    """
    return F.coalesce(F.col(name), F.raise_error(F.lit(f"an index is NULL: {name}")).cast("bigint"))


def within(df: DataFrame, axes: Sequence[str], dims: Sequence[int]) -> DataFrame:
    """``df``, where an index that is NULL or outside ``dims`` raises.

    A filter, so that it costs no job and column pruning cannot lose it; ranges on the
    index still reach the scan.
    """
    inside = reduce(lambda a, b: a & b, (
        F.coalesce((F.col(a) >= 0) & (F.col(a) < d), F.lit(False)) for a, d in zip(axes, dims)))
    wrong = F.raise_error(F.concat(
        F.lit(f"an index is NULL or outside {tuple(dims)}: "),
        F.concat_ws(",", *(F.coalesce(F.col(a).cast("string"), F.lit("NULL")) for a in axes))))
    return df.where(F.when(inside, F.lit(True)).otherwise(wrong.cast("boolean")))


def check_bounds(t: CooTable | TensorTable) -> DataFrame:
    """The entries whose index is NULL or outside the table's dimensions."""
    axes = ("row", "col") if isinstance(t, CooTable) else t.axes

    def outside(axis: str, size: int) -> Column:
        return F.col(axis).isNull() | (F.col(axis) < 0) | (F.col(axis) >= size)

    tests = [outside(axis, size) for axis, size in zip(axes, t.dims)]
    return t.df.where(reduce(lambda a, b: a | b, tests, F.lit(False)))

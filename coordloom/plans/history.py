"""Snapshots of a chain kept as differences.

A step that changes few entries needs few rows: a table of changes holds, for every saved
step, the entries that are new or have another value and those that are gone. The state at
any saved step is the last change of every coordinate up to it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from coordloom.functions import COMPLEX
from coordloom.plans.chain import Operator, chain_apply, stored_operators
from coordloom.session import discard, new_folder
from coordloom.table import CooTable

_SCHEMA = "row bigint, col bigint, re double, im double, gone boolean, step int"


def changed(before: CooTable | None, after: CooTable) -> DataFrame:
    """``row, col, re, im, gone``: what turns one state into another.

    ``gone`` marks coordinates without an entry any more, whose values are zero. Both
    states have no repeated coordinates.
    """
    now = after.merged().entries()
    if before is None:
        return now.withColumn("gone", F.lit(False))
    old = before.merged().entries().select("row", "col", F.col("re").alias("_re"), F.col("im").alias("_im"),
                                           F.lit(True).alias("_old"))
    new = now.withColumn("_new", F.lit(True))
    both = new.join(old, ["row", "col"], "full")
    gone = F.col("_new").isNull()
    same = F.col("re").eqNullSafe(F.col("_re")) & F.col("im").eqNullSafe(F.col("_im"))
    return both.where(gone | F.col("_old").isNull() | ~same).select(
        "row", "col", F.coalesce("re", F.lit(0.0)).alias("re"), F.coalesce("im", F.lit(0.0)).alias("im"),
        gone.alias("gone"))


@dataclass(frozen=True)
class History:
    """The final state and the changes between saved steps."""

    state: CooTable
    changes: DataFrame
    steps: tuple[int, ...]

    def at(self, step: int) -> CooTable:
        """The state saved at ``step``: for each coordinate its last change up to there."""
        if step not in self.steps:
            raise ValueError(f"step {step} is not among the saved ones {self.steps}")
        last = self.changes.where(F.col("step") <= step).groupBy("row", "col").agg(
            F.max_by(F.struct("re", "im", "gone"), "step").alias("_last"))
        df = last.where(~F.col("_last.gone")).select("row", "col", "_last.re", "_last.im")
        return CooTable(df, self.state.dims, unique=True)

    def snapshots(self) -> DataFrame | None:
        """The saved states as ``step, row, col, re, im``; None if there are none."""
        parts = [self.at(step).entries().select(F.lit(step).alias("step"), "*") for step in self.steps]
        return reduce(DataFrame.unionByName, parts) if parts else None


def chain_history(ops: Sequence[Operator], v: CooTable, steps: int, save_every: int, *,
                  product: str = COMPLEX, eps: float = 0.0, plan: str = "auto") -> History:
    """Like :func:`chain_apply` with ``save_every``, the snapshots kept as differences.

    Each saved state is compared with the one before by one join; only the last two are
    stored whole. The changes of a step are a folder of their own, written as the step is
    reached, so a state is read from the folders up to its step.
    """
    steps = int(steps)
    if steps < 1 or not 1 <= save_every <= steps:
        raise ValueError(f"steps must be at least 1 and save_every within 1..{steps}")
    spark = v.df.sparkSession
    ops = stored_operators(ops, v, steps)
    folder = new_folder(spark, "history")
    saved, state, before = [], v, None
    for step in range(save_every, steps, save_every):
        state = chain_apply(ops, state, save_every, product=product, eps=eps, plan=plan).state.store()
        changed(before, state).write.parquet(f"{folder}/step={step}")
        if before is not None and before.path:
            discard(spark, before.path)
        saved.append(step)
        before = state
    final = chain_apply(ops, state, steps - (saved[-1] if saved else 0), product=product, eps=eps, plan=plan).state
    changes = spark.read.schema(_SCHEMA).parquet(folder) if saved else spark.createDataFrame([], _SCHEMA)
    return History(final, changes, tuple(saved))

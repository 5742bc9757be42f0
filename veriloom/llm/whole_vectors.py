"""Vectors as whole numbers, and the exact sums that rounds of averaging need.

A component x becomes floor(1024 x). Sums, squared distances and floors of
means are integers, so results do not depend on the order of rows or tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 1024
#: Components of this size or more leave the range in which squared distances of long vectors fit in 64 bits.
RANGE = 65_536.0


def usable(vector: Column) -> Column:
    """Whether a vector is there, with components that are all there, finite and below ``RANGE`` in size."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < RANGE)
    return F.coalesce(F.forall(vector.cast("array<double>"), lambda x: F.coalesce(good(x), F.lit(False))), F.lit(False))


def whole(vector: Column) -> Column:
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * SCALE).cast("int"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column whose lists all have ``width`` numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


class Sums:
    """Count and componentwise sum of the rows given to each slot."""

    SCHEMA = "slot int, n long, total array<long>"

    def __init__(self, slots: int, width: int) -> None:
        self.n, self.total = np.zeros(slots, np.int64), np.zeros((slots, width), np.int64)

    def add(self, slot: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(slot, kind="stable")
        found, start = np.unique(slot[order], return_index=True)
        if len(found):
            self.n[found] += np.diff([*start, len(order)])
            self.total[found] += np.add.reduceat(rows[order], start, axis=0)

    def batch(self) -> pa.RecordBatch:
        used = np.flatnonzero(self.n)
        width = self.total.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * width, pa.int32()), pa.array(self.total[used].ravel()))
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(self.n[used]), lists], ["slot", "n", "total"])


def moved(sums: DataFrame, centers: np.ndarray) -> np.ndarray:
    """``centers`` with every slot that has rows at the floor of their mean.

    The totals of all tasks meet by slot and component; slots times components,
    both parameters, is what the driver receives.
    """
    cells = (
        sums.select("slot", "n", F.posexplode("total").alias("at", "x"))
        .groupBy("slot", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        .selectExpr("slot", "at", "(x - pmod(x, n)) div n as mean")
    )
    out = centers.copy()
    for r in cells.collect():
        out[r["slot"], r["at"]] = r["mean"]
    return out

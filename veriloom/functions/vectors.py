"""Expressions over embedding arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import as_column


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product accumulated in double precision."""
    products = F.zip_with(as_column(a), as_column(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def norm(v: str | Column) -> Column:
    return F.sqrt(F.aggregate(as_column(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def all_finite(v: str | Column) -> Column:
    c = as_column(v)
    return ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))

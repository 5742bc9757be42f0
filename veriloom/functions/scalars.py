"""Column expressions for numbers, hashing and null handling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: str | Column) -> Column:
    """Text to double; a decimal comma is accepted, anything else is null."""
    return F.trim(F.replace(as_column(c).cast("string"), F.lit(","), F.lit("."))).try_cast("double")


def ratio(a: str | Column, b: str | Column) -> Column:
    """``a / b``; null when the denominator is zero or null."""
    return F.try_divide(as_column(a).cast("double"), as_column(b).cast("double"))


def ratio_or_zero(a: str | Column, b: str | Column) -> Column:
    return F.coalesce(ratio(a, b), F.lit(0.0))


def is_true(condition: Column) -> Column:
    """Three-valued logic collapsed to two: null counts as false."""
    return F.coalesce(condition, F.lit(False))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def flag(condition: Column) -> Column:
    return is_true(condition).cast("int")


def blank_to_empty(c: str | Column) -> Column:
    return F.coalesce(as_column(c).cast("string"), F.lit(""))


def hash_order(seed: int | Column, *keys: str | Column) -> Column:
    """Hex digest that orders keys pseudo-randomly and identically everywhere."""
    seed_col = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat_ws("|", seed_col.cast("string"), *[as_column(k).cast("string") for k in keys]))


def hash_unit(seed: int | Column, *keys: str | Column) -> Column:
    """Uniform number in [0, 1) taken from the first 32 bits of the digest."""
    return F.conv(F.substring(hash_order(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def band(value: str | Column, cuts: list[float], labels: list[str]) -> Column:
    """Left-closed intervals: ``label[i]`` for ``cuts[i-1] <= value < cuts[i]``."""
    v = as_column(value)
    out = F.when(v.isNull(), F.lit(None).cast("string"))
    for cut, label in zip(cuts, labels):
        out = out.when(v < F.lit(float(cut)), F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def interval(value: str | Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed intervals ``(edges[i], edges[i+1]]``; null outside."""
    v = as_column(value)
    out = F.when(v.isNull(), F.lit(None).cast("string"))
    for low, high, label in zip(edges, edges[1:], labels):
        out = out.when((v > F.lit(float(low))) & (v <= F.lit(float(high))), F.lit(label))
    return out


def recode(value: str | Column, mapping: dict, default: str | None = None) -> Column:
    v = as_column(value)
    items = list(mapping.items())
    out = F.when(v == F.lit(items[0][0]), F.lit(items[0][1]))
    for key, label in items[1:]:
        out = out.when(v == F.lit(key), F.lit(label))
    return out.otherwise(F.lit(default))


def title_case(c: str | Column) -> Column:
    """Capital after every non-letter, lower case elsewhere, blanks collapsed.

    ``initcap`` only starts a word after a space, so every run of letters is
    split off first and capitalised on its own.
    """
    text = F.regexp_replace(as_column(c), r"^\s+|\s+$", "")
    pieces = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    joined = F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "")
    return F.regexp_replace(joined, r"\s+", " ")


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table built in the JVM from literals."""
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    structs = [
        F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, fields)]) for row in rows
    ]
    return spark.range(1).select(F.explode(F.array(*structs)).alias("r")).select("r.*")

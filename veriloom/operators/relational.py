"""Joins, set operations and group codes with explicit keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import join_groups, rank_by_value


def inner(left: DataFrame, right: DataFrame, keys: list[str], suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Equi-join; clashing value columns get suffixes."""
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    a = left.select(*keys, *[F.col(c).alias(c + suffixes[0] if c in clash else c) for c in left.columns if c not in keys])
    b = right.select(*keys, *[F.col(c).alias(c + suffixes[1] if c in clash else c) for c in right.columns if c not in keys])
    return a.join(b, keys)


def keep_members(df: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(members.select(*keys), keys, "left_semi")


def drop_members(df: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(members.select(*keys), keys, "left_anti")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """Value of a key table with a default for unknown keys."""
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def shared_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Number of distinct keys on both sides."""
    return left.select(*keys).distinct().intersect(right.select(*keys).distinct()).agg(F.count(F.lit(1)).alias("shared"))


def dense_codes(df: DataFrame, key: str, name: str = "code") -> DataFrame:
    """0-based code of each key in sorted order, on every row.

    Ranks are taken over the distinct keys only and joined back by key.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    codes = rank_by_value(sizes, key, key, name, descending=False)
    return join_groups(df, codes.withColumn(name, (F.col(name) - 1).cast("int")), [key], "_n").drop("_n")


def rank_change(df: DataFrame, group: str, item: str, before: str, after: str) -> DataFrame:
    """Ranks of each item in its group by two scores, and the places gained."""
    first = rank_by_value(df, before, item, "rank_before", [group])
    second = rank_by_value(df.select(group, item, after), after, item, "rank_after", [group])
    joined = first.join(second.select(group, item, "rank_after"), [group, item])
    return joined.withColumn("rank_change", F.col("rank_before") - F.col("rank_after"))


def sort_rows(df: DataFrame, order: list[Column]) -> DataFrame:
    return df.orderBy(*order)


def stack(*tables: DataFrame) -> DataFrame:
    """Union by name; columns absent from one side are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out

"""Connected components by alternating stars.

Every round hangs the larger neighbours of a node on its smallest neighbour,
then the node itself and its smaller neighbours on the smallest of those. The
edges end as stars around the smallest node of each component, after a number
of rounds that grows with the logarithm of the longest path. Rounds are written
to the shared folder, so a lost executor costs no more than one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import through_table


def _summary(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return row[0], int(row[1])


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a``, ``b``) that is not the smallest of its component."""
    current = through_table(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = _summary(current)
    while True:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(current.select("a", "b").join(least, "a").where("m < a").select("a", F.col("m").alias("b"))).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = through_table(small.union(smallest.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = _summary(current)
        if now == seen:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now

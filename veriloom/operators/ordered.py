"""Ranks, running totals, quantiles and joins that do not depend on balanced keys.

A plain window sorts one whole group in one task. The functions here cut a
group into ordered buckets, work inside the buckets, and add the totals of the
earlier buckets; a group holding a third of all rows is then spread over many
tasks. There is one path for every size; Spark joins small buckets.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import as_column, hash_order, literal_rows
from ..session import through_table

#: Values of one bracket that are put in order by one aggregate.
BRACKET_ROWS = 4096
#: Rank error of the quantile sketch, as one part in so many.
SKETCH = 4096


def _bisect(value: Column, points: list[float], inclusive: bool) -> Column:
    """Number of ``points`` below (or not above) ``value`` as a tree of CASEs."""

    def node(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        after = value >= F.lit(points[mid]) if inclusive else value > F.lit(points[mid])
        return F.when(after, node(mid + 1, high)).otherwise(node(low, mid))

    return node(0, len(points))


def in_ranges(df: DataFrame, order: list[Column], within: list[str] | None = None) -> DataFrame:
    """Rows dealt into ranges of ``within`` and ``order``, stored with the number of their range as ``_bucket``.

    One exchange samples the split points. The numbers are written with the
    rows, so later reads and retried tasks see the same ones. A group of any
    size is cut like the rest, as the order includes a tie key; Spark joins
    small ranges.
    """
    ranged = df.repartitionByRange(*[F.col(k) for k in within or []], *order)
    return through_table(ranged.withColumn("_bucket", F.spark_partition_id()), "ranges")


def hash_bucket(digest: Column) -> Column:
    """4096 even buckets in the order of a hex digest."""
    return F.substring(digest, 1, 3)


def running(
    df: DataFrame,
    order: list[Column],
    sums: dict[str, Column],
    bucket: Column,
    partition: list[str] | None = None,
) -> DataFrame:
    """Add running sums along ``order``; ``bucket`` must follow the same order."""
    keys = list(partition or [])
    rows = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    part = rows.select("*", *[F.sum(c).over(inside).alias(f"_in_{n}") for n, c in sums.items()])
    joined = part.join(_offsets(rows, sums, keys), _same(keys), "inner")
    return joined.select(
        *[F.col(c) for c in df.columns], *[(F.col(f"_in_{n}") + F.col(f"_off_{n}")).alias(n) for n in sums]
    )


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_bucket") == F.col("_k_bucket")])


def _offsets(rows: DataFrame, sums: dict[str, Column], keys: list[str]) -> DataFrame:
    """Sums over the earlier buckets of the same group, and which of its buckets this is."""
    totals = rows.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()])
    group = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_bucket")
    earlier = group.rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_bucket").alias("_k_bucket"),
        F.row_number().over(group).alias("_nth"),
        *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_off_{n}") for n in sums],
    )


def running_in_order(df: DataFrame, order: list[Column], sums: dict[str, Column], within: list[str] | None = None) -> DataFrame:
    """Running sums along ``order`` in each group, whatever the sizes of the groups.

    Rows are cut into ranges; a window works inside a range. Only a group that
    crosses a border has later ranges, at most one group per border, so the
    table of their offsets has fewer rows than there are ranges.
    """
    keys = list(within or [])
    rows = in_ranges(df.select("*", *[c.alias(f"_v_{n}") for n, c in sums.items()]), order, keys)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    part = rows.select("*", *[F.sum(f"_v_{n}").over(inside).alias(f"_in_{n}") for n in sums])
    later = _offsets(rows, {n: F.col(f"_v_{n}") for n in sums}, keys).where("_nth > 1")
    joined = part.join(F.broadcast(later), _same(keys), "left")
    return joined.select(
        *[F.col(c) for c in df.columns], *[(F.col(f"_in_{n}") + F.coalesce(f"_off_{n}", F.lit(0))).alias(n) for n in sums]
    )


def rank_by_hash(
    df: DataFrame, keys: list[str], seed: int | Column, name: str = "rank", within: list[str] | None = None
) -> DataFrame:
    """1-based rank in digest order (tie: key), per ``within`` group."""
    hashed = df.withColumn("_digest", hash_order(seed, *keys))
    ranked = running(
        hashed,
        [F.col("_digest"), *[F.col(k) for k in keys]],
        {name: F.lit(1)},
        hash_bucket(F.col("_digest")),
        within,
    )
    return ranked.drop("_digest")


def rank_by_value(
    df: DataFrame,
    value: str,
    tie: str,
    name: str = "rank",
    within: list[str] | None = None,
    descending: bool = True,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """1-based rank by value and tie key per group, with optional running sums."""
    first = F.col(value).desc() if descending else F.col(value).asc()
    return running_in_order(df, [first, F.col(tie).asc()], {name: F.lit(1), **(extra or {})}, within)


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """Exact linear-interpolated quantiles: ``(column_name, share, q)``; columns without values have none."""
    found = quantile_values(df, columns, shares)
    rows = [(c, float(s), found[c, s]) for c in columns for s in shares if (c, s) in found]
    schema = "column_name string, share double, q double"
    return literal_rows(df.sparkSession, rows, schema) if rows else df.sparkSession.createDataFrame([], schema)


@dataclass
class _Bracket:
    """Positions of one column that lie strictly between two values; no value is no border."""

    column: str
    low: float | None
    high: float | None
    before: int
    inside: int
    targets: list[int]

    def holds(self) -> Column:
        """The value, if it is inside."""
        x, within = F.col(self.column), F.lit(True)
        if self.low is not None:
            within = within & (x > F.lit(self.low))
        if self.high is not None:
            within = within & (x < F.lit(self.high))
        return F.when(within, x)

    def shares(self) -> list[float]:
        """Shares of the sketch that surround every target whatever its error."""
        sides = [(t - self.before + 0.5) / self.inside + e for t in self.targets for e in (-2 / SKETCH, 2 / SKETCH)]
        return sorted({min(max(x, 0.0), 1.0) for x in sides})


def quantile_values(df: DataFrame, columns: list[str], shares: list[float], bracket_rows: int = BRACKET_ROWS) -> dict[tuple[str, float], float]:
    """Exact quantiles of all columns by narrowing, in a few aggregates of one row each.

    A mergeable sketch surrounds every wanted position with cuts; the next
    aggregate counts the values at and below the cuts. A position at a cut is
    found; others have a smaller bracket. Brackets with few values are put in
    order by one aggregate, others are cut again. Sketches only choose the cuts
    and cannot change the result, and no values are shuffled. At most eight
    columns share an aggregate, which keeps it in one generated function.
    """
    out: dict[tuple[str, float], float] = {}
    for first in range(0, len(columns), 8):
        out |= _narrowed(df, columns[first : first + 8], shares, bracket_rows)
    return out


def _narrowed(df: DataFrame, columns: list[str], shares: list[float], bracket_rows: int) -> dict[tuple[str, float], float]:
    names = {c: f"c{i}" for i, c in enumerate(columns)}
    table = df.select(*[F.col(c).cast("double").alias(n) for c, n in names.items()])
    sizes = table.agg(*[F.count(n).alias(n) for n in names.values()]).first().asDict()
    places = {(c, s): s * (sizes[n] - 1) for c, n in names.items() if sizes[n] for s in shares}
    brackets = [
        _Bracket(n, None, None, 0, sizes[n], sorted({int(f(p)) for (k, _), p in places.items() if k == c for f in (floor, ceil)}))
        for c, n in names.items() if sizes[n]
    ]
    found: dict[tuple[str, int], float] = {}
    while brackets:
        wide = [b for b in brackets if b.inside > bracket_rows]
        small = [b for b in brackets if b.inside <= bracket_rows]
        asks = [F.percentile_approx(b.holds(), F.array(*map(F.lit, b.shares())), SKETCH).alias(f"s{i}") for i, b in enumerate(wide)]
        asks += [F.sort_array(F.collect_list(b.holds())).alias(f"v{i}") for i, b in enumerate(small)]  # few values each, as counted
        row = table.agg(*asks).first()
        for i, b in enumerate(small):
            found |= {(b.column, t): row[f"v{i}"][t - b.before] for t in b.targets}
        cuts = [sorted(set(row[f"s{i}"])) for i in range(len(wide))]
        asks = [
            F.count_if(test).alias(f"{kind}{i}_{j}")
            for i, b in enumerate(wide)
            for j, cut in enumerate(cuts[i])
            for kind, test in (("below", F.col(b.column) < F.lit(cut)), ("at", F.col(b.column) == F.lit(cut)))
        ]
        brackets = []
        if asks:
            row = table.agg(*asks).first()
        for i, b in enumerate(wide):
            edges = [(cut, row[f"below{i}_{j}"], row[f"at{i}_{j}"]) for j, cut in enumerate(cuts[i])]
            pieces: dict[int, _Bracket] = {}
            for t in b.targets:
                hit = next((cut for cut, below, at in edges if below <= t < below + at), None)
                if hit is not None:
                    found[b.column, t] = hit
                    continue
                j = sum(below <= t for _, below, _ in edges)  # cuts below the target
                low, before = (edges[j - 1][0], edges[j - 1][1] + edges[j - 1][2]) if j else (b.low, b.before)
                high, upto = (edges[j][0], edges[j][1]) if j < len(edges) else (b.high, b.before + b.inside)
                pieces.setdefault(j, _Bracket(b.column, low, high, before, upto - before, [])).targets.append(t)
            brackets += pieces.values()
    out = {}
    for (c, s), p in places.items():
        low, high = found[names[c], int(floor(p))], found[names[c], int(ceil(p))]
        out[c, s] = low + (high - low) * (p - floor(p))
    return out


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """Join a per-group table back to its rows without gathering hot groups.

    ``groups`` carries the row count of each group in ``size``. At most a
    thousand groups hold more than a thousandth of all rows; these go to the
    tasks of their rows, the others are joined by key. ``how`` is inner or left.
    """
    total = groups.agg(F.sum(size).alias("total")).scalar()
    hot = groups.where(F.col(size) * 1000 > total)
    marks = F.broadcast(hot.select(*keys))
    out = rows.join(F.broadcast(hot), keys).select(*rows.columns, *[c for c in groups.columns if c not in keys])
    cold = rows.join(marks, keys, "left_anti").join(groups.where(F.col(size) * 1000 <= total), keys, how)
    return out.unionByName(cold)


def top_k(df: DataFrame, k: int, order: list[Column], within: list[str], name: str = "rank") -> DataFrame:
    """First ``k`` rows per group; Spark prunes each group before the shuffle."""
    w = Window.partitionBy(*within).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return top_k(df, 1, [F.col(o) for o in order], keys, "_first").drop("_first")


def singleton(df: DataFrame, *cols: Column) -> Column:
    """The value of a one-row, one-column aggregate as a scalar subquery."""
    return df.agg(*cols).scalar()


__all__ = [
    "as_column",
    "exact_quantiles",
    "hash_bucket",
    "in_ranges",
    "join_groups",
    "keep_first",
    "rank_by_hash",
    "rank_by_value",
    "quantile_values",
    "running",
    "running_in_order",
    "singleton",
    "top_k",
]

"""Deterministic samples, splits and folds.

Everything is ordered by a digest of ``seed|key``; ranks over keys are counted
per digest prefix, so no single task orders all keys.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import flag, hash_order
from ..session import through_table
from .ordered import hash_bucket, join_groups, rank_by_hash, running, singleton


def sample_rows(df: DataFrame, keys: list[str], n: int | None, seed: int = 42) -> DataFrame:
    """``min(n, all)`` rows in digest order; ``None`` keeps the table."""
    if n is None:
        return df
    return df.orderBy(hash_order(seed, *keys), *keys).limit(n)


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("_rows"))


def sample_groups_to_rows(df: DataFrame, group: str, target: int, seed: int = 42) -> DataFrame:
    """Whole groups in digest order until ``target`` rows are reached."""
    sizes = group_sizes(df, group).withColumn("_digest", hash_order(seed, group))
    upto = running(sizes, [F.col("_digest"), F.col(group)], {"_upto": F.col("_rows")}, hash_bucket(F.col("_digest")))
    chosen = upto.where(F.col("_upto") - F.col("_rows") < target).select(group)
    return df.join(chosen, group, "left_semi")


def sample_groups(df: DataFrame, group: str, n: int | None, seed: int = 42, positive: Column | None = None) -> DataFrame:
    """All rows of the first ``n`` groups in digest order.

    With ``positive`` only groups having such a row are eligible.
    """
    keys = df.groupBy(group).agg(F.max(flag(positive)) .alias("_ok")).where("_ok = 1") if positive is not None else df.select(group).distinct()
    if n is not None:
        keys = keys.orderBy(hash_order(seed, group), group).limit(n)
    return df.join(keys.select(group), group, "left_semi")


def group_sample_audit(df: DataFrame, group: str, item: str, positive: Column, n: int, seed: int = 42) -> DataFrame:
    """Groups, rows, repeated pairs and excluded groups of a positive-only sample."""
    kept = sample_groups(df, group, n, seed, positive)
    pairs = kept.groupBy(group, item).agg(F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("pos"))
    facts = pairs.groupBy(group).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("dup"), F.sum("pos").alias("pos")
    )
    all_groups = df.groupBy(group).agg(F.max(flag(positive)).alias("ok"))
    return facts.agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("n").alias("rows"),
        F.sum("dup").alias("repeated_pairs"),
        F.sum("pos").alias("positives"),
    ).withColumn("groups_without_positive", singleton(all_groups, F.count_if(F.col("ok") == 0)))


def _attach(df: DataFrame, group: str, labels: DataFrame) -> DataFrame:
    """Bring per-group labels back to the rows, salting hot groups."""
    return join_groups(df, labels.join(group_sizes(df, group), group), [group], "_rows").drop("_rows")


def _cut(rank: Column, total: Column, shares: list[float], names: list[str]) -> Column:
    out = F.when(rank <= F.floor(F.lit(shares[0]) * total), F.lit(names[0]))
    for share, name in zip(shares[1:], names[1:]):
        out = out.when(rank <= F.floor(F.lit(share) * total), F.lit(name))
    return out.otherwise(F.lit(names[-1]))


#: Keys under one digest prefix that are put in order; fuller prefixes are counted again, three digits deeper.
ORDERED_KEYS = 50_000


def _digest_cuts(digests: DataFrame, ranks) -> list[str]:
    """The digests at ``ranks(total)``, 1-based; rank 0 gives the empty string, below every digest.

    Counts per prefix (at most 4,096 a time) find the prefix that holds a rank;
    only its keys are ordered. ``digests`` has one column, ``d``.
    """

    def counts(prefix: str) -> list[tuple[str, int]]:
        inside = digests.where(F.col("d").startswith(prefix)) if prefix else digests
        found = inside.groupBy(F.substring("d", 1, len(prefix) + 3).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        return sorted((r["p"], r["n"]) for r in found)

    top = counts("")
    cuts = []
    for rank in ranks(sum(n for _, n in top)):
        level, prefix, left = top, "", rank
        while left > 0:
            for prefix, n in level:
                if left <= n:
                    break
                left -= n
            if n <= ORDERED_KEYS or len(prefix) >= 32:
                row = digests.where(F.col("d").startswith(prefix)).orderBy("d").offset(left - 1).limit(1).first()
                cuts.append(row["d"])
                break
            level = counts(prefix)
        else:
            cuts.append("")
    return cuts


def _by_cuts(digest: Column, cuts: list[str], names: list[str]) -> Column:
    out = F.when(digest <= F.lit(cuts[0]), F.lit(names[0]))
    for cut, name in zip(cuts[1:], names[1:]):
        out = out.when(digest <= F.lit(cut), F.lit(name))
    return out.otherwise(F.lit(names[-1]))


def _group_digests(df: DataFrame, group: str, seed: int) -> DataFrame:
    """The digest of every group once, written: several counts read it."""
    return through_table(df.select(group).distinct().select(hash_order(seed, group).alias("d")), "group-digests")


def split_groups(
    df: DataFrame,
    group: str,
    seed: int = 42,
    shares: tuple[float, ...] = (0.7, 0.85),
    names: tuple[str, ...] = ("train", "validation", "test"),
) -> DataFrame:
    """Whole groups to splits at cumulative positions ``floor(share * groups)``.

    Rows compare their group's digest with the digests at the cuts: no join, no shuffle.
    """
    cuts = _digest_cuts(_group_digests(df, group, seed), lambda n: [math.floor(s * n) for s in shares])
    return df.withColumn("split", _by_cuts(hash_order(seed, group), cuts, list(names)))


def holdout_groups(df: DataFrame, group: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """``ceil(share * groups)`` groups to ``test``, the others to ``train``."""
    cuts = _digest_cuts(_group_digests(df, group, seed), lambda n: [math.ceil(share * n)])
    return df.withColumn("split", _by_cuts(hash_order(seed, group), cuts, ["test", "train"]))


def split_rows(
    df: DataFrame,
    keys: list[str],
    shares: tuple[float, ...],
    names: tuple[str, ...],
    seed: int = 42,
    strata: list[str] | None = None,
) -> DataFrame:
    """Row split at cumulative shares, per stratum when ``strata`` is given.

    Without strata, rows compare their digest with the digests at the cuts;
    rows with equal keys stay together.
    """
    if not strata:
        digest = hash_order(seed, *keys)
        cuts = _digest_cuts(df.select(digest.alias("d")), lambda n: [math.floor(s * n) for s in shares])
        return df.withColumn("split", _by_cuts(digest, cuts, list(names)))
    ranked = rank_by_hash(df, keys, seed, "_rank", strata)
    totals = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_total"))
    ranked = join_groups(ranked, totals, strata, "_total")
    return ranked.withColumn("split", _cut(F.col("_rank"), F.col("_total"), list(shares), list(names))).drop("_rank", "_total")


def row_folds(df: DataFrame, keys: list[str], k: int, seed: int = 42, strata: list[str] | None = None) -> DataFrame:
    """``fold`` in 0..k-1, dealt round-robin in digest order."""
    ranked = rank_by_hash(df, keys, seed, "_rank", strata)
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank")


def group_folds(df: DataFrame, group: str, k: int, seed: int = 42) -> DataFrame:
    ranked = rank_by_hash(df.select(group).distinct(), [group], seed)
    labels = ranked.select(group, F.pmod(F.col("rank") - 1, F.lit(k)).cast("int").alias("fold"))
    return _attach(df, group, labels)


def stride_sample(df: DataFrame, key: str, required: DataFrame, step: int = 19, seed: int = 42) -> DataFrame:
    """Every ``step``-th key in digest order plus every key in ``required``."""
    ranked = rank_by_hash(df, [key], seed, "_rank")
    wanted = required.select(F.col(required.columns[0]).alias(key)).distinct().withColumn("_wanted", F.lit(True))
    joined = ranked.join(wanted, key, "left")
    strided = F.pmod(F.col("_rank") - 1, F.lit(step)) == 0
    return (
        joined.where(strided | F.col("_wanted").isNotNull())
        .withColumn("origin", F.when(F.col("_wanted").isNotNull(), "required").otherwise("stride"))
        .drop("_rank", "_wanted")
    )


def split_groups_by_seed(
    df: DataFrame, group: str, seeds: list[int], shares: tuple[float, ...] = (0.7, 0.85)
) -> DataFrame:
    """``(seed, group, split)`` for all seeds in one job."""
    keys = df.select(group).distinct()
    seeded = keys.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    ranked = rank_by_hash(seeded, [group], F.col("seed"), "rank", ["seed"])
    total = singleton(keys, F.count(F.lit(1)))
    names = ["train", "validation", "test"]
    return ranked.select("seed", group, _cut(F.col("rank"), total, list(shares), names).alias("split"))


def hard_negative_variants(df: DataFrame, hard: str, weight: str) -> DataFrame:
    """Four training sets: as is, hard rows doubled in weight, repeated, both."""
    doubled = F.col(weight) * F.when(F.col(hard), 2.0).otherwise(1.0)
    repeated = df.where(F.col(hard))
    parts = {
        "original": df,
        "weighted": df.withColumn(weight, doubled),
        "enriched": df.unionByName(repeated),
        "weighted_enriched": df.withColumn(weight, doubled).unionByName(repeated.withColumn(weight, doubled)),
    }
    out = None
    for name, part in parts.items():
        named = part.withColumn("variant", F.lit(name))
        out = named if out is None else out.unionByName(named)
    return out

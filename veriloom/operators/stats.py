"""Bootstrap intervals, repeated-seed intervals, selection and registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import top_k

EPS = 1e-12
# Two-sided 95 % points of Student's t by degrees of freedom.
T_975 = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228,
         11: 2.201, 12: 2.179, 13: 2.160, 14: 2.145, 15: 2.131, 16: 2.120, 17: 2.110, 18: 2.101, 19: 2.093, 20: 2.086}


def paired_deltas(candidate: DataFrame, baseline: DataFrame, keys: list[str], metric: str, extra: list[str] | None = None) -> DataFrame:
    """``(extra…, keys…, delta)`` for queries measured by both."""
    base = baseline.select(*keys, F.col(metric).alias("_base"))
    return candidate.join(base, keys).select(*(extra or []), *keys, (F.col(metric) - F.col("_base")).alias("delta"))


# P(X <= k) of the Poisson distribution with mean 1, in units of 2 ** -32.
POISSON_CUTS = [1580030169, 3160060337, 3950075422, 4213413783, 4279248374, 4292415292, 4294609778, 4294923276, 4294962463, 4294966817, 4294967253, 4294967292]
LANES = 8


def paired_bootstrap(deltas: DataFrame, query: str, groups: list[str], seed: int = 42, draws: int = 1000) -> DataFrame:
    """Mean delta with its 95 % bootstrap interval and win / tie / loss counts.

    Every draw weighs every row by a Poisson number with mean 1, taken from a
    digest of (seed, block of draws, query); eight draws share one digest. The
    weighted sums combine before the shuffle: no row numbers and no join, and
    one row per task, group and draw leaves a task.
    """
    block = F.explode(F.sequence(F.lit(0), F.lit(-(-draws // LANES) - 1)))
    rows = deltas.select(*groups, query, "delta", block.alias("_block"))
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("_block").cast("string"), F.col(query).cast("string")), 256)

    def weight(lane: Column) -> Column:
        x = F.conv(F.substr(F.col("_digest"), lane * 8 + 1, F.lit(8)), 16, 10).cast("long")
        return sum((F.when(x >= cut, 1).otherwise(0) for cut in POISSON_CUTS), F.lit(0))

    sums = [f(lane) for lane in range(LANES) for f in (
        lambda k: F.sum(F.col(f"_w{k}") * F.col("delta")).alias(f"_s{k}"), lambda k: F.sum(f"_w{k}").alias(f"_n{k}"))]
    wide = (
        rows.withColumn("_digest", digest)
        .select(*groups, "delta", "_block", *[weight(F.lit(k)).alias(f"_w{k}") for k in range(LANES)])
        .groupBy(*groups, "_block").agg(*sums)
    )
    lanes = F.array(*[F.struct((F.col("_block") * LANES + k).alias("b"), F.try_divide(f"_s{k}", f"_n{k}").alias("m")) for k in range(LANES)])
    means = wide.select(*groups, F.explode(lanes).alias("d")).select(*groups, "d.b", "d.m").where((F.col("b") < draws) & F.col("m").isNotNull())
    spread = means.groupBy(*groups).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"))  # one value per draw
    d = F.col("delta")
    counts = deltas.groupBy(*groups).agg(
        F.avg("delta").alias("delta"),
        F.count_if(d > EPS).alias("improved"),
        F.count_if(F.abs(d) <= EPS).alias("unchanged"),
        F.count_if(d < -EPS).alias("worsened"),
    )
    return counts.join(spread, groups).select(
        *groups, "delta", F.col("ci")[0].alias("ci_low"), F.col("ci")[1].alias("ci_high"), "improved", "unchanged", "worsened"
    )


def _t_value(n: Column) -> Column:
    """The two-sided 95 % point for ``n`` values: null for one value, a series in 1 / degrees of freedom beyond the table."""
    table = F.create_map(*[F.lit(x) for pair in T_975.items() for x in pair])
    z = 1.959963984540054
    terms = [
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
    ]
    free = (n - 1).cast("double")
    series = F.lit(z)
    for power, term in enumerate(terms, 1):
        series = series + F.lit(term) / F.pow(free, F.lit(float(power)))
    return F.coalesce(F.try_element_at(table, (n - 1).cast("int")), F.when(n - 1 > max(T_975), series))


def seed_intervals(df: DataFrame, keys: list[str], metrics: list[str], seed: str = "seed", sums: list[str] | None = None) -> DataFrame:
    """Mean, sd (n-1) and t interval over seeds for each metric; one seed has neither sd nor interval."""
    aggs = [F.count_distinct(seed).alias("seeds"), *[F.sum(c).alias(c) for c in sums or []]]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_m"), F.stddev_samp(m).alias(f"{m}_s"), F.count(m).alias(f"{m}_n")]
    g = df.groupBy(*keys).agg(*aggs)
    out = [*keys, "seeds", *(sums or [])]
    for m in metrics:
        mean, sd, n = F.col(f"{m}_m"), F.col(f"{m}_s"), F.col(f"{m}_n")
        half = _t_value(n) * sd / F.sqrt(n)
        out += [
            F.round(mean, 6).alias(f"{m}_mean"), F.round(sd, 6).alias(f"{m}_std"),
            F.round(mean - half, 6).alias(f"{m}_ci_low"), F.round(mean + half, 6).alias(f"{m}_ci_high"),
        ]
    return g.select(*out)


def mean_and(df: DataFrame, keys: list[str], metrics: list[str], functions: dict) -> DataFrame:
    """Several aggregates of several metrics with flat ``metric_function`` names."""
    return df.groupBy(*keys).agg(*[F.round(f(m), 6).alias(f"{m}_{name}") for m in metrics for name, f in functions.items()])


# Names of the flags and their rules on the pair features; ``{score}`` is the first model's score.
HARD_RULES = {
    "high_lexical_overlap": "jaccard >= 0.2",
    "high_v1_probability": "{score} >= 0.5",
    "brand_match_category_mismatch": "brand_mention > 0 and category_overlap = 0",
    "category_match_wrong_intent": "category_overlap > 0 and query_coverage < 0.5",
    "similar_title": "title_coverage >= 0.5",
    "character_similar": "char_length_ratio >= 0.5",
    "attribute_conflict": "attributes_overlap = 0 and query_coverage >= 0.5",
}
HARD_FLAGS = list(HARD_RULES)


def hard_negative_flags(df: DataFrame, label: str, first_score: str) -> DataFrame:
    """Seven kinds of misleading negatives on pair features, and any of them."""
    negative = F.col(label) == 0
    out = df.withColumns({name: negative & F.expr(rule.format(score=f"`{first_score}`")) for name, rule in HARD_RULES.items()})
    return out.withColumn("is_hard", F.greatest(*[F.col(c) for c in HARD_FLAGS]))


def flag_counts(df: DataFrame, keys: list[str], flags: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.count_if(F.col(c)).alias(c) for c in flags])


def leaderboard(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Position of each model per group by the given sort keys."""
    return top_k(df, 1 << 30, order, keys, "position")


def promotion_decision(df: DataFrame, low: str = "ci_low") -> DataFrame:
    """Promote only when the whole interval of the delta is above zero."""
    return df.withColumn("decision", F.when(F.col(low) > 0, "promote").otherwise("retain"))


def append_runs(registry: DataFrame, runs: DataFrame) -> DataFrame:
    """Registry plus new runs; failed runs stay as rows with a status."""
    return registry.unionByName(runs, allowMissingColumns=True).withColumn("status", F.coalesce("status", F.lit("completed")))


def unchanged_check(new: DataFrame, old: DataFrame, keys: list[str], metrics: list[str], eps: float = EPS) -> DataFrame:
    """Rows compared and values that moved by more than ``eps``, per metric.

    A row on one side only, and a value that is null on one side only, has changed.
    """
    side = lambda df, mark: df.select(*keys, *[F.col(m).alias(f"{mark}{m}") for m in metrics], F.lit(True).alias(f"{mark}here"))
    a, b = side(new, "_n_"), side(old, "_o_")
    same_key = [a[k].eqNullSafe(b[k]) for k in keys]
    joined = a.join(b, same_key, "full_outer")

    def moved(m: str) -> Column:
        x, y = F.col(f"_n_{m}"), F.col(f"_o_{m}")
        apart = F.when(x.isNull() | y.isNull(), ~x.eqNullSafe(y)).otherwise(F.abs(x - y) > eps)
        return F.count_if(F.col("_n_here").isNull() | F.col("_o_here").isNull() | apart)

    wide = joined.agg(F.count(F.lit(1)).alias("rows"), *[moved(m).alias(m) for m in metrics])
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col("rows").alias("compared"), F.col(m).alias("changed")) for m in metrics])
    return wide.select(F.explode(pairs).alias("p")).select("p.*")


def extremes(df: DataFrame, value: str, tie: list[str], n: int) -> DataFrame:
    """The ``n`` largest and ``n`` smallest rows without repeats."""
    largest = df.orderBy(F.desc(value), *tie).limit(n)
    smallest = df.orderBy(F.asc(value), *tie).limit(n)
    return largest.unionByName(smallest).dropDuplicates()

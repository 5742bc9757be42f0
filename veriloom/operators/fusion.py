"""Fusion of ranked lists and choice of its parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import top_k
from .retrieval import SCORE_DIGITS, filter_results

# The parameter grids and the weights of the candidate union.
ALPHAS = [0.20, 0.35, 0.50, 0.65, 0.80]
RRF_KS = [20, 60, 100]
UNION_WEIGHTS = {"lexical": 0.45, "semantic": 0.45, "bm25": 0.10}


def minmax(value: str | Column, partition: list[str]) -> Column:
    """Scaled to [0, 1] per group; a constant group becomes zero."""
    v = F.col(value) if isinstance(value, str) else value
    w = Window.partitionBy(*partition)
    low, high = F.min(v).over(w), F.max(v).over(w)
    return F.when(high > low, (v - low) / (high - low)).otherwise(F.lit(0.0))


def align_lists(lists: DataFrame, query: str, doc: str, base: tuple[str, ...] = ("lexical", "semantic"), extra: tuple[str, ...] = ("bm25",)) -> DataFrame:
    """One row per (query, document) with score and rank of every source.

    Candidates are the documents of the ``base`` lists; ``extra`` lists only
    lend their scores. Missing scores are zero before scaling, missing ranks
    stay null. One shuffle replaces a chain of outer joins.
    """
    sources = [*base, *extra]
    wide = lists.groupBy(query, doc).agg(
        *[F.max(F.when(F.col("source") == s, F.col("score"))).alias(f"{s}_score") for s in sources],
        *[F.max(F.when(F.col("source") == s, F.col("rank"))).alias(f"{s}_rank") for s in sources],
    )
    kept = wide.where(F.coalesce(*[F.col(f"{s}_rank") for s in base]).isNotNull())
    filled = kept.withColumns({f"{s}_score": F.coalesce(f"{s}_score", F.lit(0.0)) for s in sources})
    return filled.withColumns({f"{s}_scaled": minmax(f"{s}_score", [query]) for s in sources})


def weighted(alpha: float) -> Column:
    return F.lit(alpha) * F.col("lexical_scaled") + F.lit(1 - alpha) * F.col("semantic_scaled")


def reciprocal(k: int) -> Column:
    return F.coalesce(1 / (k + F.col("lexical_rank")), F.lit(0.0)) + F.coalesce(1 / (k + F.col("semantic_rank")), F.lit(0.0))


def union_score() -> Column:
    parts = [F.lit(w) * F.col(f"{s}_scaled") for s, w in UNION_WEIGHTS.items()]
    return parts[0] + parts[1] + parts[2]


def fuse(
    aligned: DataFrame, query: str, doc: str, k: int = 100, alphas: list[float] = ALPHAS, rrf_ks: list[int] = RRF_KS, union: bool = True
) -> DataFrame:
    """``(method, parameter, query, doc, score, rank)`` for the whole grid at once.

    Ties fall to the smaller id compared as text.
    """
    entries = [
        F.struct(F.lit("weighted").alias("method"), F.lit(a).alias("parameter"), weighted(a).alias("score")) for a in alphas
    ]
    entries += [
        F.struct(F.lit("rrf").alias("method"), F.lit(float(n)).alias("parameter"), reciprocal(n).alias("score")) for n in rrf_ks
    ]
    if union:
        entries.append(F.struct(F.lit("union").alias("method"), F.lit(0.0).alias("parameter"), union_score().alias("score")))
    scored = aligned.select(query, doc, F.explode(F.array(*entries)).alias("e")).select(
        "e.method", "e.parameter", query, doc, F.round("e.score", SCORE_DIGITS).alias("score")
    )
    return top_k(scored, k, [F.desc("score"), F.col(doc).cast("string").asc()], ["method", "parameter", query])


def first_seen_union(lists: DataFrame, query: str, doc: str, order: dict[str, int]) -> DataFrame:
    """Distinct documents in order of first appearance over the lists."""
    place = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    first = (
        lists.where(F.col("source").isin(list(order)))
        .withColumn("_list", place[F.col("source")])
        .groupBy(query, doc)
        .agg(F.min(F.struct("_list", "rank")).alias("_first"))
    )
    w = Window.partitionBy(query).orderBy("_first")
    return first.select(query, doc, F.row_number().over(w).alias("position"))


def choose_parameters(metrics: DataFrame, metric: str, groups: list[str], parameter: str = "parameter") -> DataFrame:
    """Best mean of ``metric`` per group; ties to the smaller parameter."""
    means = metrics.groupBy(*groups, parameter).agg(F.round(F.avg(metric), 9).alias("mean_value"))
    return top_k(means, 1, [F.desc("mean_value"), F.asc(parameter)], groups, "_best").drop("_best")


def deployed_parameter(choices: DataFrame, groups: list[str], parameter: str = "parameter") -> DataFrame:
    """Median of the per-seed choices (one row per seed)."""
    return choices.groupBy(*groups).agg(F.median(parameter).alias(parameter))


def pool_size(k: int) -> int:
    """Documents that are fused before filters cut them to ``k``."""
    return max(5 * k, 100)


def batch_search(
    fused: DataFrame, aligned: DataFrame, chosen: DataFrame, catalogue: DataFrame, query: str, doc: str, filters: dict[str, str], k: int
) -> DataFrame:
    """Results of all queries for every chosen method, filtered and ranked anew.

    ``fused`` holds the pools of all methods and parameters, ``chosen`` one
    ``parameter`` (in hundredths) per method, a handful of rows. ``source`` says
    which of the two lists hold the document.
    """
    picked = chosen.select(F.col("method").alias("_m"), F.col("parameter").alias("_p"))
    own = (F.col("method") == F.col("_m")) & (F.round(F.col("parameter") * 100) == F.col("_p"))
    pool = fused.where(F.col("rank") <= pool_size(k)).join(F.broadcast(picked), own).drop("_m", "_p")
    both = F.when(F.col("lexical_rank").isNull(), "semantic").when(F.col("semantic_rank").isNull(), "lexical").otherwise("both")
    parts = aligned.select(query, doc, "lexical_score", "semantic_score", both.alias("source"))
    return filter_results(pool.join(parts, [query, doc]), catalogue, ["method", query], doc, filters, k)

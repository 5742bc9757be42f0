"""Classification, ranking, retrieval and regression metrics as aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import literal_rows, ratio, ratio_or_zero
from .ordered import _bisect, rank_by_value, running_in_order, singleton

THRESHOLDS = [float(x) for x in np.linspace(0.1, 0.9, 33)]
RETRIEVAL_KS = [1, 5, 10, 20, 50, 100]
EPS = 2.220446049250313e-16


def _counts(label: str, prediction: str, weight: Column | None = None) -> list[Column]:
    y, p = F.col(label), F.col(prediction)
    n = F.lit(1) if weight is None else weight

    def total(condition: Column, name: str) -> Column:
        return F.sum(F.when(condition, n).otherwise(0)).alias(name)

    return [
        total((y == 1) & (p == 1), "tp"),
        total((y == 0) & (p == 1), "fp"),
        total((y == 1) & (p == 0), "fn"),
        total((y == 0) & (p == 0), "tn"),
    ]


def _scores(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    return {
        "precision": ratio_or_zero(tp, tp + fp),
        "recall": ratio_or_zero(tp, tp + fn),
        "f1": ratio_or_zero(2 * tp, 2 * tp + fp + fn),
    }


def _rounded(df: DataFrame, keep: list[str], values: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keep, *[F.round(v, digits).alias(v) for v in values])


def binary_metrics(df: DataFrame, label: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    agg = df.groupBy(*(by or [])).agg(*_counts(label, prediction))
    out = agg.withColumns({"accuracy": ratio_or_zero(tp + tn, n), **_scores(tp, fp, fn), "support": n, "positive_rate": ratio(tp + fn, n)})
    return _rounded(out, [*(by or []), "support"], ["accuracy", "precision", "recall", "f1", "positive_rate"])


def confusion_matrix(df: DataFrame, label: str, prediction: str, levels: list[int]) -> DataFrame:
    """Every (actual, predicted) cell, empty ones as zero."""
    cells = literal_rows(df.sparkSession, [(a, p) for a in levels for p in levels], "actual int, predicted int")
    counts = df.groupBy(F.col(label).alias("actual"), F.col(prediction).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return cells.join(counts, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def classification_report(df: DataFrame, label: str, prediction: str, classes: list[int]) -> DataFrame:
    """Per-class rows plus accuracy, macro and weighted averages.

    Only the cell counts leave the fact table; the rest works on a few rows.
    """
    cells = df.groupBy(F.col(label).alias("a"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    per_class = (
        cells.withColumn("class", F.explode(F.array(*[F.lit(c) for c in classes])))
        .groupBy("class")
        .agg(
            F.sum(F.when((F.col("a") == F.col("class")) & (F.col("p") == F.col("class")), F.col("n")).otherwise(0)).alias("tp"),
            F.sum(F.when((F.col("a") != F.col("class")) & (F.col("p") == F.col("class")), F.col("n")).otherwise(0)).alias("fp"),
            F.sum(F.when((F.col("a") == F.col("class")) & (F.col("p") != F.col("class")), F.col("n")).otherwise(0)).alias("fn"),
        )
        .withColumns({**_scores(F.col("tp"), F.col("fp"), F.col("fn")), "support": F.col("tp") + F.col("fn")})
    )
    values = ["precision", "recall", "f1"]
    rows = per_class.select(F.col("class").cast("string").alias("class"), *values, "support")
    macro = per_class.agg(*[F.avg(v).alias(v) for v in values], F.sum("support").alias("support"))
    weighted = per_class.agg(
        *[ratio(F.sum(F.col(v) * F.col("support")), F.sum("support")).alias(v) for v in values], F.sum("support").alias("support")
    )
    accuracy = per_class.agg(ratio(F.sum("tp"), F.sum("support")).alias("v"), F.sum("support").alias("support"))
    out = (
        rows.unionByName(accuracy.select(F.lit("accuracy").alias("class"), *[F.col("v").alias(v) for v in values], "support"))
        .unionByName(macro.withColumn("class", F.lit("macro avg")))
        .unionByName(weighted.withColumn("class", F.lit("weighted avg")))
    )
    return _rounded(out, ["class", "support"], values)


def threshold_table(df: DataFrame, label: str, score: str, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """Precision, recall, F1 and predicted positives at every threshold.

    One pass counts rows per gap between thresholds; the suffix sums run over
    those few counts.
    """
    slots = df.groupBy(_bisect(F.col(score), thresholds, True).alias("slot")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos")
    )
    grid = literal_rows(df.sparkSession, [(0, -1.0), *[(i + 1, t) for i, t in enumerate(thresholds)]], "slot int, threshold double")
    filled = grid.join(slots, "slot", "left")
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(0))
    n, pos = F.coalesce("n", F.lit(0)), F.coalesce("pos", F.lit(0))
    sums = filled.select(
        "slot", "threshold",
        F.sum(n).over(above).alias("selected"), F.sum(pos).over(above).alias("tp"),
        F.sum(n).over(whole).alias("total"), F.sum(pos).over(whole).alias("positives"),
    ).where("slot > 0")
    tp, fp, fn = F.col("tp"), F.col("selected") - F.col("tp"), F.col("positives") - F.col("tp")
    return sums.withColumns(_scores(tp, fp, fn)).select(
        "threshold", "precision", "recall", "f1", ratio("selected", "total").alias("predicted_positive_rate")
    )


def operating_points(table: DataFrame) -> DataFrame:
    """Best F1, recall near .75, precision near .80, threshold near .5; first on ties."""
    # Names and targets of the points.
    picks = {
        "maximum_f1": -F.col("f1"),
        "recall_focused": F.abs(F.col("recall") - 0.75),
        "precision_focused": F.abs(F.col("precision") - 0.80),
        "balanced_default": F.abs(F.col("threshold") - 0.5),
    }
    row = F.struct(*table.columns)
    wide = table.agg(*[F.min_by(row, F.struct(key.alias("k"), F.col("threshold").alias("t"))).alias(name) for name, key in picks.items()])
    named = F.array(*[F.struct(F.lit(n).alias("operating_point"), F.col(n).alias("row")) for n in picks])
    return wide.select(F.explode(named).alias("e")).select("e.operating_point", "e.row.*")


def score_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """``(score, pos, neg, tp, fp)`` per distinct score, cumulated from the top."""
    hist = df.groupBy(F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg")
    )
    return running_in_order(hist, [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("neg")})


def ranking_areas(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact ROC area and average precision, equal scores counted as one step."""
    curve = score_curve(df, label, score)
    tp, fp, pos, neg = (F.col(c).cast("double") for c in ("tp", "fp", "pos", "neg"))
    sums = curve.agg(
        F.sum("pos").cast("double").alias("p"),
        F.sum("neg").cast("double").alias("n"),
        F.sum(neg * (tp - pos / 2)).alias("area"),
        F.sum(pos * tp / (tp + fp)).alias("ap"),
    )
    return sums.select(
        F.round(F.try_divide("area", F.col("p") * F.col("n")), 6).alias("roc_auc"), F.round(F.try_divide("ap", "p"), 6).alias("average_precision")
    )


def curve_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """ROC and precision-recall points per distinct score."""
    curve = score_curve(df, label, score)
    p, n = singleton(curve, F.sum("pos")), singleton(curve, F.sum("neg"))
    return curve.select(
        "score",
        F.round(F.try_divide(F.col("tp"), p), 6).alias("tpr"),
        F.round(F.try_divide(F.col("fp"), n), 6).alias("fpr"),
        F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"),
    )


def probability_losses(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Log loss, Brier score and expected calibration error."""
    y = F.col(label).cast("double")
    p = F.col(score)
    clipped = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    per_bin = df.groupBy(F.least(F.floor(p * bins), F.lit(bins - 1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(y).alias("y"),
        F.sum(p).alias("p"),
        F.sum(-(y * F.log(clipped) + (1 - y) * F.log(1 - clipped))).alias("ll"),
        F.sum((p - y) * (p - y)).alias("sq"),
    )
    n = F.sum("n")
    return per_bin.agg(
        F.round(F.sum("ll") / n, 6).alias("log_loss"), F.round(F.sum("sq") / n, 6).alias("brier"), F.round(F.sum(F.abs(F.col("y") - F.col("p"))) / n, 6).alias("ece")
    )


def error_lists(df: DataFrame, label: str, prediction: str, score: str, tie: list[str], n: int = 500, threshold: float = 0.5) -> DataFrame:
    """Worst false positives, false negatives and the rows nearest the threshold."""
    y, p, s = F.col(label), F.col(prediction), F.col(score)
    wrong_pos = df.where((y == 0) & (p == 1)).orderBy(F.desc(score), *tie).limit(n).withColumn("error_type", F.lit("false_positive"))
    wrong_neg = df.where((y == 1) & (p == 0)).orderBy(F.asc(score), *tie).limit(n).withColumn("error_type", F.lit("false_negative"))
    hard = df.orderBy(F.abs(s - threshold), *tie).limit(n).withColumn("error_type", F.lit("hardest"))
    return wrong_pos.unionByName(wrong_neg).unionByName(hard)


def segment_performance(df: DataFrame, label: str, prediction: str, segments: dict[str, Column]) -> DataFrame:
    """Rows, positive rate and P/R/F1 per bucket of several segmentations, one pass."""
    pairs = F.array(*[F.struct(F.lit(n).alias("segment"), c.cast("string").alias("bucket")) for n, c in segments.items()])
    long = df.select(label, prediction, F.explode(pairs).alias("s")).select(label, prediction, "s.*")
    out = binary_metrics(long, label, prediction, ["segment", "bucket"])
    return out.select("segment", "bucket", F.col("support").alias("rows"), "positive_rate", "precision", "recall", "f1")


def _discount(rank: Column) -> Column:
    return 1 / F.log2(rank + 1)


def _ideal(hits: Column, k: int) -> Column:
    """Ideal discounted gain of ``min(hits, k)`` binary relevances."""
    table, total = [0.0], 0.0
    for i in range(1, k + 1):
        total += 1 / float(np.log2(i + 1))
        table.append(total)
    return F.element_at(F.array(*[F.lit(x) for x in table]), (F.least(hits, F.lit(k)) + 1).cast("int"))


def group_ranking_metrics(df: DataFrame, group: str, item: str, label: str, score: str) -> DataFrame:
    """NDCG@1/3/5/10, MRR and P/R/MAP@5,10 per group; equal scores rank by id.

    MAP is the mean precision at the hits inside the first k. Ranks are taken
    bucket-wise, so one huge group is not sorted by one task, and every metric
    is a partial aggregate over (rank, running hits).
    """
    y = F.col(label) == 1
    ranked = rank_by_value(
        df.select(group, item, F.col(label), score), score, item, "rank", [group], True, {"hits": F.when(y, 1).otherwise(0)}
    )
    rank = F.col("rank")
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(y).alias("pos"), F.min(F.when(y, rank)).alias("first_hit")]
    for k in (1, 3, 5, 10):
        aggs.append(F.sum(F.when(y & (rank <= k), _discount(rank)).otherwise(0.0)).alias(f"dcg{k}"))
    for k in (5, 10):
        inside = y & (rank <= k)
        aggs += [F.count_if(inside).alias(f"h{k}"), F.sum(F.when(inside, F.col("hits") / rank).otherwise(0.0)).alias(f"ap{k}")]
    g = ranked.groupBy(group).agg(*aggs)
    cols = {f"ndcg_{k}": ratio_or_zero(f"dcg{k}", _ideal(F.col("pos"), k)) for k in (1, 3, 5, 10)}
    cols["mrr"] = F.coalesce(1 / F.col("first_hit"), F.lit(0.0))
    for k in (5, 10):
        cols[f"precision_{k}"] = F.col(f"h{k}") / F.least(F.col("n"), F.lit(k))
        cols[f"recall_{k}"] = F.col(f"h{k}") / F.greatest(F.col("pos"), F.lit(1))
        cols[f"map_{k}"] = ratio_or_zero(f"ap{k}", f"h{k}")
    return g.select(group, *[F.round(c, 6).alias(name) for name, c in cols.items()])


def retrieval_metrics(ranked: DataFrame, judgments: DataFrame, keys: list[str], query: str, doc: str, methods: DataFrame | None = None) -> DataFrame:
    """Per (method keys, query): recall, hit rate, precision at k, MRR, MAP, NDCG, coverage.

    ``ranked(keys…, query, doc, rank)`` holds at most 100 rows per list.
    ``methods(keys…)`` adds the methods for queries without any result; the
    judged queries decide which queries count.
    """
    relevant = judgments.select(query, doc, F.lit(1).alias("rel"))
    totals = judgments.groupBy(query).agg(F.count(F.lit(1)).alias("total"))
    listed = ranked.join(relevant, [query, doc], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    upto = Window.partitionBy(*keys, query).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # at most 100 rows
    listed = listed.withColumn("hits", F.sum("rel").over(upto))
    rank, hit = F.col("rank"), F.col("rel") == 1
    aggs = [F.count(F.lit(1)).alias("len"), F.min(F.when(hit, rank)).alias("first_hit")]
    aggs += [F.count_if(hit & (rank <= k)).alias(f"h{k}") for k in RETRIEVAL_KS]
    aggs += [F.sum(F.when(hit & (rank <= k), F.col("hits") / rank).otherwise(0.0)).alias(f"ap{k}") for k in (10, 100)]
    aggs.append(F.sum(F.when(hit & (rank <= 10), _discount(rank)).otherwise(0.0)).alias("dcg"))
    g = listed.groupBy(*keys, query).agg(*aggs)
    frame = totals
    if keys:
        known = (methods if methods is not None else ranked).select(*keys).distinct()
        names = known.agg(F.collect_set(F.struct(*keys))).scalar()  # a handful of methods
        frame = totals.withColumn("_m", F.explode(names)).select(query, "total", "_m.*")
    frame = frame.join(g, [*keys, query], "left")
    zero = F.lit(0)
    length = F.coalesce("len", zero)
    cols: dict[str, Column] = {}
    for k in RETRIEVAL_KS:
        h = F.coalesce(f"h{k}", zero)
        cols[f"recall_{k}"] = h / F.greatest(F.col("total"), F.lit(1))
        cols[f"hit_rate_{k}"] = (h > 0).cast("double")
        cols[f"precision_{k}"] = ratio_or_zero(h, F.least(F.lit(k), length))
    cols["mrr"] = F.coalesce(1 / F.col("first_hit"), F.lit(0.0))
    for k in (10, 100):
        cols[f"map_{k}"] = F.coalesce(f"ap{k}", F.lit(0.0)) / F.greatest(F.col("total"), F.lit(1))
    cols["ndcg_10"] = ratio_or_zero(F.coalesce("dcg", F.lit(0.0)), _ideal(F.col("total"), 10))
    cols["candidate_coverage"] = F.least(length / 100, F.lit(1.0))
    cols["zero_result_rate"] = (length == 0).cast("double")
    cols["availability"] = F.lit(1.0)
    return frame.select(*keys, query, *[c.alias(n) for n, c in cols.items()])


def mean_metrics(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("queries"))


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Round report columns once, at the end."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def regression_metrics(df: DataFrame, actual: str, predicted: str, digits: int = 4) -> DataFrame:
    e = F.col(actual) - F.col(predicted)
    agg = df.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(actual).alias("variance")
    )
    return agg.select(
        F.round("mae", digits).alias("mae"),
        F.round("mse", 1).alias("mse"),
        F.round(F.sqrt("mse"), digits).alias("rmse"),
        F.round(1 - F.try_divide("mse", "variance"), 6).alias("r2"),
    )


def residuals(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.withColumn("residual", F.col(actual) - F.col(predicted))


def batch_summary(df: DataFrame, probability: str, prediction: str, band: str, bands: list[str]) -> DataFrame:
    """Rows, predicted positives, mean probability and one zero-filled count per band."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(prediction), F.lit(0)).alias("predicted_positive"),
        F.round(F.avg(probability), 6).alias("mean_probability"),
        *[F.count_if(F.col(band) == b).alias(f"band_{i}") for i, b in enumerate(bands)],
    )


def high_risk(df: DataFrame, band: str, value: str, probability: str, tie: str) -> DataFrame:
    return df.where(F.col(band) == value).orderBy(F.desc(probability), F.asc(tie))


def fill_levels(counts: DataFrame, levels: list[str], column: str) -> DataFrame:
    """Counts on a fixed axis of levels, absent ones as zero."""
    axis = literal_rows(counts.sparkSession, [(i, v) for i, v in enumerate(levels)], f"position int, {column} string")
    return axis.join(counts, column, "left").select("position", column, F.coalesce("n", F.lit(0)).alias("n"))

"""Classifier, ranker and regression evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import hash_unit, interval
from ..functions.text import words
from ..operators import clean as C
from ..operators import metrics as M
from ..operators import stats as ST
from ..operators.profile import histogram
from ..operators.sampling import hard_negative_variants
from . import roles
from . import sql_text as Q
from .registry import query
from .text_queries import featured_pairs, pair_features_ctes

_CELLS = "count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp, count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 0 AND prediction = 0) AS tn"


def _prf(tp="tp", fp="fp", fn="fn") -> str:
    return (
        f"coalesce({tp}::DOUBLE / nullif({tp} + {fp}, 0), 0) AS precision, coalesce({tp}::DOUBLE / nullif({tp} + {fn}, 0), 0) AS recall, "
        f"coalesce(2 * {tp}::DOUBLE / nullif(2 * {tp} + {fp} + {fn}, 0), 0) AS f1"
    )


@query(
    "E1_binary_metrics",
    f"""WITH {roles.SCORED}, g AS (SELECT {_CELLS} FROM scored), m AS (SELECT *, {_prf()} FROM g)
    SELECT tp + fp + fn + tn AS support, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
    round(f1, 6) AS f1, round((tp + fn)::DOUBLE / (tp + fp + fn + tn), 6) AS positive_rate FROM m""",
)
def _(t):
    return M.binary_metrics(roles.scored(t), "label", "prediction")


@query(
    "E2_confusion_matrix",
    f"""WITH {roles.SCORED} SELECT CAST(a AS INTEGER) AS actual, CAST(p AS INTEGER) AS predicted, (SELECT count(*) FROM scored WHERE label = a AND prediction = v.p) AS n
    FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(a, p)""",
)
def _(t):
    return M.confusion_matrix(roles.scored(t), "label", "prediction", [0, 1])


@query(
    "E3_classification_report",
    f"""WITH {roles.SCORED}, g AS (SELECT {_CELLS} FROM scored),
    c AS (SELECT '1' AS class, {_prf()}, tp + fn AS support FROM g UNION ALL SELECT '0', {_prf('tn', 'fn', 'fp')}, tn + fp FROM g),
    a AS (SELECT class, precision, recall, f1, support FROM c UNION ALL SELECT 'accuracy', acc, acc, acc, n FROM (SELECT (tp + tn)::DOUBLE / (tp + fp + fn + tn) AS acc, tp + fp + fn + tn AS n FROM g)
    UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM c
    UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM c)
    SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM a""",
)
def _(t):
    return M.classification_report(roles.scored(t), "label", "prediction", [0, 1])


_GRID = ", ".join(f"({x!r}::DOUBLE)" for x in M.THRESHOLDS)
_THRESHOLDS = f"""th AS (SELECT * FROM (VALUES {_GRID}) v(threshold)),
    tc AS (SELECT threshold, count(*) FILTER (label = 1 AND p >= threshold) AS tp, count(*) FILTER (label = 0 AND p >= threshold) AS fp, count(*) FILTER (label = 1 AND p < threshold) AS fn, count(*) AS n FROM scored, th GROUP BY threshold),
    tt AS (SELECT threshold, {_prf()}, (tp + fp)::DOUBLE / n AS predicted_positive_rate FROM tc)"""
_TT = ["precision", "recall", "f1", "predicted_positive_rate"]


@query("E4_threshold_table", f"WITH {roles.SCORED}, {_THRESHOLDS} SELECT threshold, {', '.join(f'round({c}, 6) AS {c}' for c in _TT)} FROM tt")
def _(t):
    return M.rounded(M.threshold_table(roles.scored(t), "label", "p"), _TT)


@query(
    "E5_operating_points",
    f"WITH {roles.SCORED}, {_THRESHOLDS} "
    + " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{n}' AS operating_point, threshold, {', '.join(f'round({c}, 6) AS {c}' for c in _TT)} FROM tt ORDER BY {k}, threshold LIMIT 1)"
        for n, k in [
            ("maximum_f1", "-f1"), ("recall_focused", "abs(recall - 0.75::DOUBLE)"),
            ("precision_focused", "abs(precision - 0.80::DOUBLE)"), ("balanced_default", "abs(threshold - 0.5::DOUBLE)"),
        ]
    ),
)
def _(t):
    return M.rounded(M.operating_points(M.threshold_table(roles.scored(t), "label", "p")), _TT)


_CURVE = """h AS (SELECT p AS score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY p),
    cv AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM h)"""


@query(
    "E6_ranking_areas",
    f"""WITH {roles.SCORED}, {_CURVE} SELECT round(sum(neg * (tp - pos / 2::DOUBLE)) / (sum(pos) * sum(neg)::DOUBLE), 6) AS roc_auc,
    round(sum(pos * tp::DOUBLE / (tp + fp)) / sum(pos), 6) AS average_precision FROM cv""",
)
def _(t):
    return M.ranking_areas(roles.scored(t), "label", "p")


@query(
    "E6_ranking_areas_bucketed",
    f"""WITH {roles.SCORED.replace('floor(', '(').replace('* 1000) / 1000', '* 1000)')}, {_CURVE} SELECT round(sum(neg * (tp - pos / 2::DOUBLE)) / (sum(pos) * sum(neg)::DOUBLE), 6) AS roc_auc,
    round(sum(pos * tp::DOUBLE / (tp + fp)) / sum(pos), 6) AS average_precision FROM cv""",
)
def _(t):
    """Untied scores through the path for more distinct scores than one task orders."""
    df = roles.scored(t).withColumn("p", hash_unit(42, "event_id") * 1000)
    return M.ranking_areas(df, "label", "p")


@query(
    "E6_curve_points",
    f"""WITH {roles.SCORED}, {_CURVE} SELECT score, round(tp::DOUBLE / (SELECT sum(pos) FROM h), 6) AS tpr, round(fp::DOUBLE / (SELECT sum(neg) FROM h), 6) AS fpr,
    round(tp::DOUBLE / (tp + fp), 6) AS precision FROM cv""",
)
def _(t):
    return M.curve_points(roles.scored(t), "label", "p")


@query(
    "E7_probability_losses",
    f"""WITH {roles.SCORED}, c AS (SELECT label, p, least(greatest(p, {M.EPS!r}::DOUBLE), 1 - {M.EPS!r}::DOUBLE) AS q, least(floor(p * 10), 9) AS bin FROM scored),
    e AS (SELECT bin, abs(sum(label) - sum(p)) AS d FROM c GROUP BY bin)
    SELECT round(avg(-(label * ln(q) + (1 - label) * ln(1 - q))), 6) AS log_loss, round(avg((p - label) * (p - label)), 6) AS brier,
    round((SELECT sum(d) FROM e) / count(*), 6) AS ece FROM c""",
)
def _(t):
    return M.probability_losses(roles.scored(t), "label", "p")


# pairs with a digest score stand for a classifier's output

_SCORED_PAIRS = f"""{pair_features_ctes()}, sp0 AS (SELECT f.term_id, f.doc_id, f.label, jaccard, query_coverage, title_coverage, brand_mention, category_overlap, char_length_ratio, attributes_overlap,
    {Q.words('query')} AS qw, {Q.words('title')} AS tw, category, {roles.sql_unit("f.term_id || '|' || f.doc_id")} AS p FROM feats f JOIN pairs USING (term_id, doc_id)),
    sp AS (SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS prediction FROM sp0)"""


def scored_pairs(t):
    return roles.stored(t, "scored_pairs", lambda: _scored_pairs(t))


def _scored_pairs(t):
    df = featured_pairs(t).withColumn("p", hash_unit(42, "term_id", "doc_id"))
    return df.withColumn("prediction", (F.col("p") >= 0.5).cast("int"))


@query(
    "E8_error_lists",
    Q.every_term(f"""WITH {_SCORED_PAIRS}, o AS (SELECT term_id, doc_id, category, label, prediction, p, jaccard FROM sp)
    SELECT *, 'false_positive' AS error_type FROM (SELECT * FROM o WHERE label = 0 AND prediction = 1 ORDER BY p DESC, term_id, doc_id LIMIT 500)
    UNION ALL SELECT *, 'false_negative' FROM (SELECT * FROM o WHERE label = 1 AND prediction = 0 ORDER BY p, term_id, doc_id LIMIT 500)
    UNION ALL SELECT *, 'hardest' FROM (SELECT * FROM o ORDER BY abs(p - 0.5::DOUBLE), term_id, doc_id LIMIT 500)"""),
)
def _(t):
    df = scored_pairs(t).select("term_id", "doc_id", "category", "label", "prediction", "p", "jaccard")
    return M.error_lists(df, "label", "prediction", "p", ["term_id", "doc_id"])


_BUCKETS = ["(-0.01, 0.0]", "(0.0, 0.2]", "(0.2, 0.5]", "(0.5, 1.0]"]


@query(
    "E9_segment_performance",
    Q.every_term(f"""WITH {_SCORED_PAIRS}, l AS (SELECT label, prediction, 'category' AS segment, category AS bucket FROM sp UNION ALL SELECT label, prediction, 'query_length', CAST(len(qw) AS VARCHAR) FROM sp
      UNION ALL SELECT label, prediction, 'title_length', CAST(len(tw) AS VARCHAR) FROM sp UNION ALL SELECT label, prediction, 'lexical_overlap',
      CASE WHEN jaccard <= 0 THEN '(-0.01, 0.0]' WHEN jaccard <= 0.2 THEN '(0.0, 0.2]' WHEN jaccard <= 0.5 THEN '(0.2, 0.5]' ELSE '(0.5, 1.0]' END FROM sp),
    g AS (SELECT segment, bucket, {_CELLS}, count(*) AS n FROM l GROUP BY ALL), m AS (SELECT *, {_prf()} FROM g)
    SELECT segment, bucket, n AS "rows", round((tp + fn)::DOUBLE / n, 6) AS positive_rate, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m"""),
)
def _(t):
    segments = {
        "category": F.col("category"),
        "query_length": F.size(words("query")),
        "title_length": F.size(words("title")),
        "lexical_overlap": interval("jaccard", [-0.01, 0.0, 0.2, 0.5, 1.0], _BUCKETS),
    }
    return M.segment_performance(scored_pairs(t), "label", "prediction", segments)


_RANKED = f"""{roles.GRADED_EVENTS}, rk AS (SELECT term_id, label, row_number() OVER w AS rank, sum(label) OVER (PARTITION BY term_id ORDER BY score DESC, item_id ROWS UNBOUNDED PRECEDING) AS hits FROM graded WINDOW w AS (PARTITION BY term_id ORDER BY score DESC, item_id)),
    ag AS (SELECT term_id, count(*) AS n, CAST(sum(label) AS BIGINT) AS pos, min(CASE WHEN label = 1 THEN rank END) AS first_hit, """ + ", ".join(
    [f"coalesce(sum(CASE WHEN label = 1 AND rank <= {k} THEN 1 / log2(rank + 1) END), 0) AS dcg{k}" for k in (1, 3, 5, 10)]
    + [f"count(*) FILTER (label = 1 AND rank <= {k}) AS h{k}, coalesce(sum(CASE WHEN label = 1 AND rank <= {k} THEN hits::DOUBLE / rank END), 0) AS ap{k}" for k in (5, 10)]
) + " FROM rk GROUP BY term_id)"
_RANK_OUT = ", ".join(
    [f"round(coalesce(dcg{k} / list_sum(list_transform(range(1, least(pos, {k}) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg_{k}" for k in (1, 3, 5, 10)]
    + ["round(coalesce(1::DOUBLE / first_hit, 0), 6) AS mrr"]
    + [f"round(h{k}::DOUBLE / least(n, {k}), 6) AS precision_{k}, round(h{k}::DOUBLE / greatest(pos, 1), 6) AS recall_{k}, round(coalesce(ap{k} / nullif(h{k}, 0), 0), 6) AS map_{k}" for k in (5, 10)]
)


@query("E10_group_ranking_metrics", f"WITH {_RANKED} SELECT term_id, {_RANK_OUT} FROM ag")
def _(t):
    return M.group_ranking_metrics(roles.graded_events(t), "term_id", "item_id", "label", "score")


@query("E10_group_ranking_bucketed", f"WITH {_RANKED} SELECT term_id, {_RANK_OUT} FROM ag")
def _(t):
    """Same metrics through the path for groups too large for one task."""
    return M.group_ranking_metrics(roles.graded_events(t), "term_id", "item_id", "label", "score")


@query(
    "E17_hard_negative_flags",
    Q.every_term(f"""WITH {_SCORED_PAIRS}, h AS (SELECT term_id, label = 0 AND jaccard >= 0.2 AS f1, label = 0 AND p >= 0.5 AS f2, label = 0 AND brand_mention > 0 AND category_overlap = 0 AS f3,
      label = 0 AND category_overlap > 0 AND query_coverage < 0.5 AS f4, label = 0 AND title_coverage >= 0.5 AS f5, label = 0 AND char_length_ratio >= 0.5 AS f6,
      label = 0 AND attributes_overlap = 0 AND query_coverage >= 0.5 AS f7 FROM sp), sd AS (SELECT unnest([42, 52]) AS seed)
    SELECT seed, {', '.join(f'count(*) FILTER (f{i + 1}) AS {n}' for i, n in enumerate(ST.HARD_FLAGS))}, count(*) FILTER (f1 OR f2 OR f3 OR f4 OR f5 OR f6 OR f7) AS is_hard
    FROM h, sd GROUP BY seed"""),
)
def _(t):
    flagged = ST.hard_negative_flags(scored_pairs(t), "label", "p")
    seeded = flagged.withColumn("seed", F.explode(F.array(F.lit(42), F.lit(52))))
    return ST.flag_counts(seeded, ["seed"], [*ST.HARD_FLAGS, "is_hard"])


@query(
    "P10_hard_pair_variants",
    Q.every_term(f"""WITH {_SCORED_PAIRS}, h AS (SELECT label = 0 AND (jaccard >= 0.2 OR p >= 0.5 OR (brand_mention > 0 AND category_overlap = 0) OR (category_overlap > 0 AND query_coverage < 0.5) OR title_coverage >= 0.5
      OR char_length_ratio >= 0.5 OR (attributes_overlap = 0 AND query_coverage >= 0.5)) AS hard FROM sp), c AS (SELECT count(*) AS n, count(*) FILTER (hard) AS k FROM h)
    SELECT 'original' AS variant, n AS "rows", n::DOUBLE AS weight FROM c UNION ALL SELECT 'weighted', n, (n + k)::DOUBLE FROM c
    UNION ALL SELECT 'enriched', n + k, (n + k)::DOUBLE FROM c UNION ALL SELECT 'weighted_enriched', n + k, (n + 3 * k)::DOUBLE FROM c"""),
)
def _(t):
    flagged = ST.hard_negative_flags(scored_pairs(t), "label", "p").select("term_id", "doc_id", "label", "is_hard", F.lit(1.0).alias("weight"))
    return hard_negative_variants(flagged, "is_hard", "weight").groupBy("variant").agg(F.count(F.lit(1)).alias("rows"), F.sum("weight").alias("weight"))


# --- regression and batch reports ---------------------------------------------------------

_REG = "reg AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS actual, l_quantity * p_retailprice AS predicted FROM lineitem JOIN part ON l_partkey = p_partkey)"


def scored_regression(t):
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("actual"), (F.col("l_quantity") * F.col("p_retailprice")).alias("predicted")
    )


@query(
    "E18_regression_metrics",
    f"""WITH {_REG} SELECT round(avg(abs(actual - predicted)), 4) AS mae, round(avg((actual - predicted) * (actual - predicted)), 1) AS mse,
    round(sqrt(avg((actual - predicted) * (actual - predicted))), 4) AS rmse, round(1 - avg((actual - predicted) * (actual - predicted)) / var_pop(actual), 6) AS r2 FROM reg""",
)
def _(t):
    return M.regression_metrics(scored_regression(t), "actual", "predicted")


@query("E19_residuals", f"WITH {_REG} SELECT *, actual - predicted AS residual FROM reg")
def _(t):
    return M.residuals(scored_regression(t), "actual", "predicted")


@query(
    "E19_residual_histogram",
    f"""WITH {_REG}, e AS (SELECT actual - predicted AS v FROM reg), r AS (SELECT min(v) AS lo, max(v) AS hi FROM e),
    b AS (SELECT CAST(least(floor((v - lo) / (hi - lo) * 30), 29) AS INTEGER) AS bin, lo, hi FROM e, r)
    SELECT bin, round(any_value(lo) + bin * ((any_value(hi) - any_value(lo)) / 30), 4) AS low, round(any_value(lo) + (bin + 1) * ((any_value(hi) - any_value(lo)) / 30), 4) AS high, count(*) AS n FROM b GROUP BY bin""",
)
def _(t):
    return histogram(M.residuals(scored_regression(t), "actual", "predicted"), "residual")


_BAND = "CASE WHEN p < 0.4 THEN 'Düşük' WHEN p < 0.7 THEN 'Orta' ELSE 'Yüksek' END"


@query(
    "E20_batch_summary",
    f"""WITH {roles.SCORED}, b AS (SELECT *, {_BAND} AS band FROM scored)
    SELECT count(*) AS "rows", CAST(sum(prediction) AS BIGINT) AS predicted_positive, round(avg(p), 6) AS mean_probability,
    count(*) FILTER (band = 'Düşük') AS band_0, count(*) FILTER (band = 'Orta') AS band_1, count(*) FILTER (band = 'Yüksek') AS band_2 FROM b""",
)
def _(t):
    banded = roles.scored(t).withColumn("band", C.risk_band("p"))
    return M.batch_summary(banded, "p", "prediction", "band", C.BANDS)


@query("E20_high_risk_list", f"WITH {roles.SCORED} SELECT event_id, p FROM scored WHERE {_BAND} = 'Yüksek' ORDER BY p DESC, event_id")
def _(t):
    banded = roles.scored(t).withColumn("band", C.risk_band("p"))
    return M.high_risk(banded, "band", "Yüksek", "p", "event_id").select("event_id", "p")


@query(
    "E23_experiment_registry",
    f"""WITH {roles.SCORED}, c AS (SELECT event_type, count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
    count(*) FILTER (label = 1 AND prediction = 0) AS fn FROM scored GROUP BY 1)
    SELECT event_type AS model, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, 'completed' AS status, NULL AS error FROM c
    UNION ALL SELECT 'broken', NULL, 'failed', 'did not converge'""",
)
def _(t):
    first = M.binary_metrics(roles.scored(t), "label", "prediction", ["event_type"]).select(F.col("event_type").alias("model"), "f1", F.lit("completed").alias("status"))
    failed = t.spark.range(1).select(F.lit("broken").alias("model"), F.lit("failed").alias("status"), F.lit("did not converge").alias("error"))
    return ST.append_runs(first, failed)


@query("M13_prior_baseline", f"WITH {roles.SCORED} SELECT event_id, label, round((SELECT avg(label) FROM scored), 6) AS score FROM scored")
def _(t):
    from ..operators.models import prior_scores

    df = roles.scored(t).select("event_id", "label")
    return prior_scores(df, df, "label").select("event_id", "label", F.round("score", 6).alias("score"))


_GROUPED = f"""gp AS (SELECT term_id, item_id, label, row_number() OVER (PARTITION BY term_id ORDER BY score DESC, item_id) AS rank, score, score_b FROM graded)"""


@query(
    "M20_pair_generation",
    f"""WITH {roles.GRADED_EVENTS},
    o AS (SELECT term_id, item_id, label, score, row_number() OVER (PARTITION BY term_id, label ORDER BY md5('42|' || item_id), item_id) - 1 AS r, count(*) OVER (PARTITION BY term_id, label) AS m FROM graded),
    k AS (SELECT p.term_id, p.item_id AS positive, p.score AS ps, p.r AS pr, s.i FROM o p, range(0, 4) s(i) WHERE p.label = 1),
    nn AS (SELECT term_id, item_id AS negative, score AS ns, r, m FROM o WHERE label = 0)
    SELECT k.term_id, positive, negative, round(ps - ns, 6) AS d_score FROM k JOIN nn ON nn.term_id = k.term_id AND nn.r = (k.pr * 4 + k.i) % nn.m AND k.i < nn.m""",
)
def _(t):
    from ..operators.models import ranking_pairs

    out = ranking_pairs(roles.graded_events(t), "term_id", "item_id", "label", ["score"], 4)
    return out.select("term_id", "positive", "negative", F.round("d_score", 6).alias("d_score"))


@query(
    "M23_margin_confidence",
    f"WITH {roles.SCORED}, m AS (SELECT event_id, (p - 0.5::DOUBLE) * 4 AS margin, p FROM scored) SELECT event_id, round(1 / (1 + exp(-abs(margin))), 6) AS margin_confidence, round(greatest(p, 1 - p), 6) AS class_confidence FROM m",
)
def _(t):
    from ..operators.scoring import class_confidence, margin_confidence

    df = roles.scored(t).withColumn("margin", (F.col("p") - 0.5) * 4)
    return df.select("event_id", F.round(margin_confidence("margin"), 6).alias("margin_confidence"), F.round(class_confidence("p"), 6).alias("class_confidence"))


@query(
    "M24_matching_signals",
    f"WITH {_SCORED_PAIRS} SELECT term_id, doc_id, round(p, 6) AS score, jaccard, query_coverage, title_coverage, brand_mention, category_overlap FROM sp",
)
def _(t):
    from ..operators.scoring import with_signals

    return with_signals(scored_pairs(t), ["term_id", "doc_id"], F.round("p", 6))

"""Training, selection, calibration, ranking and batch scoring."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import clean_review
from ..operators import features as X
from ..operators import metrics as M
from ..operators import models as D
from ..operators import relevance as V
from ..operators import sampling as S
from ..operators import scoring as B
from ..operators import stats as ST
from ..session import scratch_path, through_table
from . import roles
from .evaluation_queries import scored_pairs
from .registry import query

NUMERIC = ["tenure", "total", "monthly", "c_acctbal"]
CATEGORICAL = ["contract"]
PAIR_COLUMNS = [*X.PAIR_FEATURES, "bm25"]


# Training frames are read many times by iterative fits, so each is written once.


def customers(t):
    return roles.stored(t, "churn", lambda: _customers(t))


def _customers(t):
    """Customer role with a label: no order in the last recorded year."""
    last = t.orders.agg(F.max("o_orderdate")).scalar()
    recent = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_order"))
    base = roles.customer_role(t).join(recent, "c_custkey", "left")
    label = (F.coalesce(F.col("last_order") < F.add_months(last, -12), F.lit(True))).cast("int")
    return base.withColumn("label", label).select("c_custkey", *NUMERIC, *CATEGORICAL, "label")


def customer_split(t):
    return roles.stored(t, "churn_split", lambda: _customer_split(t))


def customer_folds(t):
    return roles.stored(t, "churn_folds", lambda: S.row_folds(customers(t), ["c_custkey"], 5, strata=["label"]))


def _customer_split(t):
    return S.split_rows(customers(t), ["c_custkey"], (0.6, 0.8), ("train", "validation", "test"), strata=["label"])


def reviews(t):
    return roles.stored(t, "reviews", lambda: _reviews(t))


def _reviews(t):
    base = roles.review_texts(t).select("doc_id", clean_review("text").alias("text"), F.col("quality").alias("label"))
    return S.split_rows(base, ["doc_id"], (0.6, 0.8), ("train", "validation", "test"), strata=["label"])


def priced_lines(t):
    return roles.stored(t, "priced_lines", lambda: _priced_lines(t), roles.FIT_ROWS)


def _priced_lines(t):
    # Lines are neither sorted nor spilled for the few parts of a task.
    joined = t.lineitem.join(t.part.hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey"))
    base = joined.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax",
        F.col("p_size").cast("double").alias("p_size"), "p_retailprice", F.col("l_extendedprice").alias("label"),
    )
    return S.holdout_groups(base, "l_orderkey")


LINE_FEATURES = ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice"]


def _part(df, name):
    return df.where(F.col("split") == name).drop("split")


def _tabular(estimator):
    return [*D.tabular_stages(NUMERIC, CATEGORICAL), estimator]


def _text(estimator):
    return [*D.text_stages("text", "features", max_features=20_000, max_df=0.98), estimator]


def _fit_and_test(split, stages):
    model = Pipeline(stages=stages).fit(D.balanced_weights(_part(split, "train"), "label"))
    return D.classification_summary(D.with_scores(model, _part(split, "test")), "label")


@query("M1_tabular_preprocessing")
def _(t):
    split = customer_split(t)
    model = Pipeline(stages=D.tabular_stages(NUMERIC, CATEGORICAL)).fit(_part(split, "train"))
    return model.transform(split).select("c_custkey", "split", vector_to_array("features").alias("features"))


@query("M2_l1_feature_selection")
def _(t):
    split = customer_split(t)
    stages = [*D.tabular_stages(NUMERIC, CATEGORICAL), D.L1Selector(inputCol="features", outputCol="kept", labelCol="label")]
    out = Pipeline(stages=stages).fit(_part(split, "train")).transform(split)
    return out.select("c_custkey", "split", vector_to_array("kept").alias("kept"))


@query("M3_univariate_selection")
def _(t):
    split = priced_lines(t)
    stages = [VectorAssembler(inputCols=LINE_FEATURES, outputCol="features"), D.univariate_selector("features", "label", 3)]
    out = Pipeline(stages=stages).fit(_part(split, "train")).transform(split)
    return out.select("l_orderkey", "l_linenumber", "split", vector_to_array("selected").alias("selected"))


@query("M4_importance_report")
def _(t):
    train = _part(customer_split(t), "train")
    model = Pipeline(stages=_tabular(D.classifier("random_forest"))).fit(train)
    return D.importance_report(model.transform(train), "features", model.stages[-1].featureImportances)


@query("M5_top_terms")
def _(t):
    model = Pipeline(stages=_text(D.classifier("naive_bayes"))).fit(_part(reviews(t), "train"))
    theta = model.stages[-1].theta.toArray()
    return D.top_terms(t.spark, model.stages[1].vocabulary, theta[1] - theta[0], 30)


@query("M6_logistic_regression")
def _(t):
    split = reviews(t)
    weighted = D.balanced_weights(_part(split, "train"), "label")
    model = Pipeline(stages=_text(D.classifier("logistic_regression", weight="class_weight"))).fit(weighted)
    return D.classification_summary(D.with_scores(model, _part(split, "test")), "label")


@query("M7_linear_svc")
def _(t):
    return _fit_and_test(reviews(t), _text(D.classifier("linear_svc", weight="class_weight")))


@query("M8_naive_bayes")
def _(t):
    return _fit_and_test(reviews(t), _text(D.classifier("naive_bayes")))


@query("M9_decision_tree")
def _(t):
    return _fit_and_test(customer_split(t), _tabular(D.classifier("decision_tree", weight="class_weight")))


@query("M9_random_forest")
def _(t):
    return _fit_and_test(customer_split(t), _tabular(D.classifier("random_forest", weight="class_weight")))


@query("M10_extra_trees_substitute")
def _(t):
    return _fit_and_test(customer_split(t), _tabular(D.classifier("extra_trees", weight="class_weight")))


@query("M11_gradient_boosting")
def _(t):
    return _fit_and_test(customer_split(t), _tabular(D.classifier("gradient_boosting")))


@query("M12_sgd_substitutes")
def _(t):
    split, out = customer_split(t), None
    for name in ("sgd_log_loss", "sgd_modified_huber"):
        row = _fit_and_test(split, _tabular(D.classifier(name))).withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query("M14_regression_models")
def _(t):
    split, out = priced_lines(t), None
    for name in ("linear", "ridge", "random_forest", "gradient_boosting"):
        stages = [VectorAssembler(inputCols=LINE_FEATURES, outputCol="features"), D.regressor(name, **_LIGHTER.get(name, {}))]
        row = D.regression_summary(Pipeline(stages=stages).fit(_part(split, "train")), _part(split, "test"), "label").withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


# Twenty fits, and a forest of depth 18 over all lines, take minutes with the full ensembles; see the README.
_LIGHTER = {"random_forest": {"numTrees": 60, "maxDepth": 8}, "gradient_boosting": {"maxIter": 20}}


@query("M15_cross_validation")
def _(t):
    folded = customer_folds(t)
    candidates = {n: [D.classifier(n, **_LIGHTER.get(n, {}))] for n in ("logistic_regression", "decision_tree", "random_forest", "gradient_boosting")}
    results = D.cross_validate(folded, candidates, "label", "fold", 5, D.tabular_stages(NUMERIC, CATEGORICAL))
    return D.cv_summary(results, ["f1", "roc_auc", "average_precision"])


@query("M16_grid_search")
def _(t):
    folded = customer_folds(t)
    lr = LogisticRegression(maxIter=30)
    grid = [(lr.regParam, [0.001, 0.01, 0.1]), (lr.elasticNetParam, [0.0, 0.5])]
    _best, table = D.grid_search(folded, _tabular(lr), grid, BinaryClassificationEvaluator(), "fold", 5)
    return table


@query("M17_retrain_and_test")
def _(t):
    split = customer_split(t)
    return D.retrain_and_test(_part(split, "train"), _part(split, "validation"), _part(split, "test"), _tabular(D.classifier("logistic_regression")), "label")


def pair_frame(t):
    return roles.stored(t, "pair_frame", lambda: _pair_frame(t))


def pair_split(t):
    return roles.stored(t, "pair_split", lambda: S.split_groups(pair_frame(t), "term_id"))


def pair_folds(t):
    return roles.stored(t, "pair_folds", lambda: S.group_folds(pair_frame(t), "term_id", 3))


def _pair_frame(t):
    return scored_pairs(t).select("term_id", "doc_id", F.concat_ws("-", "term_id", "doc_id").alias("pair"), *PAIR_COLUMNS, "label", "p", F.lit(1.0).alias("weight"))


def _pair_stages(name="logistic_regression", columns=PAIR_COLUMNS, weight="weight"):
    return [VectorAssembler(inputCols=list(columns), outputCol="features"), D.classifier(name, weight=weight)]


@query("M18_out_of_fold_scores")
def _(t):
    folded = pair_folds(t)
    return D.out_of_fold(folded, _pair_stages(), "pair", "fold", 3).select("pair", "term_id", "fold", "label", F.round("oof", 6).alias("oof"))


@query("M18_stacking")
def _(t):
    """Metrics of two base models and of the model stacked on their scores, on groups that none of them saw."""
    split = pair_split(t)
    train = roles.stored(t, "stack_train", lambda: S.group_folds(_part(split, "train"), "term_id", 3))
    bases = {"base_probability": _pair_stages(), "base_margin": _pair_stages("linear_svc")}
    final = lambda scores: _pair_stages("tuned_logistic", [*PAIR_COLUMNS, *scores])
    return V.two_levels(train, _part(split, "test"), bases, final, "pair", "label", "fold", 3)


@query("M19_calibration")
def _(t):
    """Models and calibrators are fitted on training folds and judged on the validation rows."""
    split = customer_split(t)
    train = roles.stored(t, "calibration_folds", lambda: S.row_folds(_part(split, "train"), ["c_custkey"], 3, strata=["label"]))
    rows, stages = _part(split, "validation"), _tabular(D.classifier("linear_svc"))
    plain = D.with_scores(Pipeline(stages=stages).fit(train), rows, "margin").withColumn("p", B.margin_confidence("margin"))
    plain = through_table(plain, "scored")
    out = D.calibration_summary(plain, "label", "p", "uncalibrated")
    for method in ("sigmoid", "isotonic"):
        scored = through_table(V.cross_calibrated(train, rows, stages, "label", "fold", 3, method), "scored")
        out = out.unionByName(D.calibration_summary(scored, "label", "calibrated", method))
    return out


# The objectives that are compared, and the ranks that top-k pairs must touch.
RANKERS = {"pairwise": ("pairwise", None), "ndcg": ("ndcg", None), "ndcg_topk": ("ndcg", 4), "map": ("map", None)}


@query("M20_learning_to_rank")
def _(t):
    split = pair_split(t)
    columns = ["jaccard", "query_coverage", "title_coverage", "attributes_overlap", "bm25"]
    train, test, out = _part(split, "train"), _part(split, "test"), None
    for name, (objective, top) in RANKERS.items():
        model = V.fit_ranking_rounds(train, "term_id", "doc_id", "label", columns, "bm25", objective, top)
        detail = M.group_ranking_metrics(D.apply_ranker(model, test, columns), "term_id", "doc_id", "label", "rank_score")
        row = M.mean_metrics(detail, [], ["ndcg_10", "mrr", "recall_10"]).withColumn("objective", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query("M21_hard_negative_training")
def _(t):
    split = pair_split(t)
    train = ST.hard_negative_flags(_part(split, "train"), "label", "p").drop(*ST.HARD_FLAGS)
    variants = roles.stored(t, "hard_variants", lambda: S.hard_negative_variants(train, "is_hard", "weight"))
    test, out = _part(split, "test"), None
    for name in ("original", "weighted", "enriched", "weighted_enriched"):
        model = Pipeline(stages=_pair_stages()).fit(variants.where(F.col("variant") == name).drop("variant"))
        row = D.classification_summary(D.with_scores(model, test), "label").withColumn("variant", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query("M22_score_customers")
def _(t):
    split = customer_split(t)
    model = Pipeline(stages=_tabular(D.classifier("logistic_regression"))).fit(_part(split, "train"))
    return B.score_customers(model, split)


@query("M22_score_values")
def _(t):
    split = priced_lines(t)
    stages = [VectorAssembler(inputCols=LINE_FEATURES, outputCol="features"), D.regressor("linear")]
    return B.score_values(Pipeline(stages=stages).fit(_part(split, "train")), split)


@query("M22_score_sentiment")
def _(t):
    split = reviews(t)
    model = Pipeline(stages=_text(D.classifier("naive_bayes"))).fit(_part(split, "train"))
    return B.score_sentiment(model, split).drop("text")


@query("M22_score_relevance")
def _(t):
    split = pair_split(t)
    model = Pipeline(stages=_pair_stages()).fit(_part(split, "train"))
    return B.score_relevance(model, split).select("term_id", "doc_id", "split", "prediction", "relevance_score", "score_type", "relevance")


@query("M25_model_persistence")
def _(t):
    split = customer_split(t)
    model = Pipeline(stages=_tabular(D.classifier("logistic_regression"))).fit(_part(split, "train"))
    path = scratch_path(t.spark, "churn-model")
    D.save_model(model, path, {"features": [*NUMERIC, *CATEGORICAL], "seed": D.SEED, "split": "60/20/20"})
    loaded, metadata = D.load_model(t.spark, path)
    return D.classification_summary(D.with_scores(loaded, _part(split, "test")), "label").withColumn("seed", F.lit(metadata["seed"]))


def _relevance_frame(t):
    product = X.product_document("title", "category", "brand", "attributes")
    text = roles.pairs(t).select("*", product.alias("product_text")).withColumn("pair_text", X.pair_document("query", F.col("product_text")))
    frame = X.pair_features(text, "query", "title", "category", "brand", "attributes").select(
        "term_id", "doc_id", "label", T.normalize_basic("query").alias("query_text"), "product_text", "pair_text", *X.PAIR_FEATURES
    )
    return S.split_groups(frame, "term_id")


@query("T14_relevance_features")
def _(t):
    """Word, character and combined blocks beside the explicit columns."""
    frame, texts, out = roles.stored(t, "relevance_frame", lambda: _relevance_frame(t)), ["query_text", "product_text", "pair_text"], None
    every = D.relevance_blocks("combined", *texts)
    split = through_table(D.stored_blocks(frame, ["term_id", "doc_id"], F.col("split") == "train", every).drop(*texts), "relevance_blocks")
    for name in ("word", "char", "combined"):
        rows = D.stored_features(split, D.relevance_stages(name, *texts, X.PAIR_FEATURES)[-1], ["split", "label"])
        model = Pipeline(stages=[D.classifier("logistic_regression")]).fit(_part(rows, "train"))
        row = D.classification_summary(D.with_scores(model, _part(rows, "test")), "label").withColumn("feature_set", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def _product_pairs(t):
    """Pairs with the columns of a product; language and source take the places of gender and age group."""
    return roles.pairs(t).select("*", F.col("doc_id").alias("item_id"), F.col("category").alias("gender"), F.col("brand").alias("age_group"))


@query("T14_dense_features")
def _(t):
    """The fitted stage, saved and loaded, over training and test groups."""
    split = roles.stored(t, "product_pairs", lambda: S.split_groups(_product_pairs(t), "term_id"))
    path = scratch_path(t.spark, "dense-features-model")
    V.DenseFeatures().fit(_part(split, "train")).write().save(path)
    model = V.DenseFeaturesModel.load(path)
    rounded = [F.round(c, 6).alias(c) for c in model.names()]
    return model.transform(split).select("term_id", "doc_id", "split", *rounded)


@query("R17_classifier_ranking")
def _(t):
    split = pair_split(t)
    model = Pipeline(stages=_pair_stages()).fit(_part(split, "train"))
    return B.rank_catalogue(model, _part(split, "test"), "term_id", "doc_id", 10).select("term_id", "doc_id", "label", "relevance_score", "rank")

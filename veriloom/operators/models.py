"""Training, selection, calibration and ranking on ``pyspark.ml``.

Every fitted stage sees the training rows only; all stages and fitted
pipelines can be written with ``save``.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import (
    CountVectorizerModel,
    Imputer,
    OneHotEncoder,
    StandardScaler,
    StringIndexer,
    UnivariateFeatureSelector,
    VectorAssembler,
    VectorSlicer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasLabelCol, HasOutputCol, HasOutputCols
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.util import inheritable_thread_target

from ..functions import text as T
from ..functions.scalars import literal_rows
from ..session import through_table
from .clean import most_frequent
from .metrics import binary_metrics, probability_losses, ranking_areas, regression_metrics
from .ordered import join_groups, rank_by_hash, top_k

SEED = 42

# --- custom stages -----------------------------------------------------------------------


class ModeImputer(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Fill missing text with the most frequent training value (smallest on ties)."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> Model:
        columns = self.getInputCols()
        row = dataset.sparkSession.range(1).select(*[most_frequent(dataset, c).cast("string").alias(c) for c in columns]).first()
        return ModeImputerModel(inputCols=columns, outputCols=self.getOutputCols(), modes=[row[c] for c in columns])


class ModeImputerModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    modes = Param(Params._dummy(), "modes", "fill values", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, modes=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        fills = zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault(self.modes))
        return dataset.withColumns({out: F.coalesce(F.col(c).cast("string"), F.lit(m)) for c, out, m in fills})


class TfidfVocabulary(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """The ``vocabSize`` most frequent terms (ties: smaller term first) with their smoothed document frequencies.

    Terms are counted as rows and never kept as lists of a whole partition. A
    ``minDF`` or ``maxDF`` below 1 is a share of the documents.
    """

    vocabSize = Param(Params._dummy(), "vocabSize", "largest vocabulary", TypeConverters.toInt)
    minDF = Param(Params._dummy(), "minDF", "least documents of a term", TypeConverters.toFloat)
    maxDF = Param(Params._dummy(), "maxDF", "most documents of a term", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, vocabSize=20_000, minDF=1.0, maxDF=float(2**63)):
        super().__init__()
        self._setDefault(vocabSize=20_000, minDF=1.0, maxDF=float(2**63))
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> Model:
        terms = F.col(self.getInputCol())
        n = dataset.count()
        low, high = (x if x >= 1 else x * n for x in (self.getOrDefault(self.minDF), self.getOrDefault(self.maxDF)))

        def counted(items: Column, name: str) -> DataFrame:
            """Outer rows, as ``term_counts`` has them: a filter below would make the terms a second time."""
            rows = dataset.select(F.explode_outer(items).alias("term")).where("term is not null")
            return rows.groupBy("term").agg(F.count(F.lit(1)).alias(name))

        inside = counted(F.array_distinct(terms), "df").where((F.col("df") >= low) & (F.col("df") <= high))
        kept = counted(terms, "cf").join(inside, "term").orderBy(F.desc("cf"), F.asc("term")).limit(self.getOrDefault(self.vocabSize)).collect()
        if not kept:
            raise ValueError("no term is in as many documents as asked")
        weights = np.log((n + 1.0) / (np.array([r["df"] for r in kept]) + 1.0)) + 1.0
        return TfidfModel(inputCol=self.getInputCol(), outputCol=self.getOutputCol(), terms=[r["term"] for r in kept], weights=weights.tolist())


class TfidfModel(Model, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Unit vectors of ``(1 + ln(count)) * (ln((1 + N) / (1 + df)) + 1)`` in place of the column of terms."""

    terms = Param(Params._dummy(), "terms", "vocabulary in its order", TypeConverters.toListString)
    weights = Param(Params._dummy(), "weights", "weight of every term", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, terms=None, weights=None):
        super().__init__()
        self._set(**self._input_kwargs)

    @property
    def vocabulary(self) -> list[str]:
        return self.getOrDefault(self.terms)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        counter = CountVectorizerModel.from_vocabulary(self.vocabulary, inputCol=self.getInputCol(), outputCol=self.getOutputCol())
        counted = counter.transform(dataset).drop(self.getInputCol())
        weights = dataset.sparkSession.sparkContext.broadcast(np.array(self.getOrDefault(self.weights)))

        def run(batches):
            for batch in batches:
                at = batch.num_columns - 1
                yield batch.set_column(at, batch.schema.names[at], _weighted(batch.column(at), weights.value))

        # Whole rows, not a column function: Spark does not take nested lambdas, which make the terms, as its arguments.
        # The terms stay behind: they are many times the text.
        vectors = counted.mapInArrow(run, StructType([*counted.schema.fields[:-1], StructField(self.getOutputCol(), VectorUDT())]))
        return vectors.withMetadata(self.getOutputCol(), {"ml_attr": {"num_attrs": len(self.vocabulary)}})


def _weighted(vectors: pa.Array, weights: np.ndarray) -> pa.Array:
    """Counts of all rows of a batch as unit vectors of weighted, damped counts."""
    counts, indices = vectors.field("values"), vectors.field("indices")
    offsets = counts.offsets.to_numpy() - counts.offsets[0].as_py()
    places = indices.flatten().to_numpy(zero_copy_only=False)
    flat = (1 + np.log(counts.flatten().to_numpy(zero_copy_only=False))) * weights[places]
    lengths = np.diff(offsets)
    squares = np.bincount(np.repeat(np.arange(len(lengths)), lengths), weights=flat * flat, minlength=len(lengths))
    flat /= np.repeat(np.sqrt(squares), lengths)
    parts = [vectors.field(c) for c in ("type", "size", "indices")]
    return pa.StructArray.from_arrays([*parts, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], ["type", "size", "indices", "values"])


class Terms(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Text to terms: ``word`` gives words and word pairs, ``char`` padded 3- to 5-grams."""

    analyzer = Param(Params._dummy(), "analyzer", "word or char", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, analyzer="word"):
        super().__init__()
        self._setDefault(analyzer="word")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        text, name = F.coalesce(F.col(self.getInputCol()), F.lit("")), self.getOutputCol()
        if self.getOrDefault(self.analyzer) == "char":
            return dataset.withColumn(name, F.flatten(F.transform(T.words(F.lower(text)), lambda w: T.char_ngrams(w))))
        toks = dataset.withColumn(name, T.tokens(text))  # a column of its own: word pairs name it several times
        return toks.withColumn(name, F.concat(name, T.bigrams(F.col(name))))


class L1Selector(Estimator, HasInputCol, HasOutputCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Keep features whose L1-logistic weight is at least the median weight."""

    regParam = Param(Params._dummy(), "regParam", "L1 strength", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, labelCol=None, regParam=0.001):
        super().__init__()
        self._setDefault(regParam=0.001)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> Transformer:
        lr = LogisticRegression(
            featuresCol=self.getInputCol(), labelCol=self.getLabelCol(), elasticNetParam=1.0, regParam=self.getOrDefault(self.regParam), maxIter=50
        )
        weights = np.abs(lr.fit(dataset).coefficients.toArray())
        kept = [int(i) for i in np.flatnonzero(weights >= np.median(weights))]
        return VectorSlicer(inputCol=self.getInputCol(), outputCol=self.getOutputCol(), indices=kept)


# --- feature pipelines --------------------------------------------------------------------


def tabular_stages(numeric: list[str], categorical: list[str], output: str = "features") -> list:
    """Median fill and scaling for numbers, mode fill and one-hot codes for text."""
    filled = [f"{c}_filled" for c in numeric]
    stages = [
        Imputer(inputCols=numeric, outputCols=filled, strategy="median"),
        VectorAssembler(inputCols=filled, outputCol="_numeric"),
        StandardScaler(inputCol="_numeric", outputCol="_scaled", withMean=True),
    ]
    if not categorical:
        return [*stages, VectorAssembler(inputCols=["_scaled"], outputCol=output)]
    texts, codes, hots = ([f"{c}_{s}" for c in categorical] for s in ("text", "code", "hot"))
    return [
        *stages,
        ModeImputer(inputCols=categorical, outputCols=texts),
        StringIndexer(inputCols=texts, outputCols=codes, handleInvalid="keep"),
        OneHotEncoder(inputCols=codes, outputCols=hots, handleInvalid="keep"),
        VectorAssembler(inputCols=["_scaled", *hots], outputCol=output),
    ]


def text_stages(
    column: str, output: str, analyzer: str = "word", max_features: int = 20_000, min_df: float = 2.0, max_df: float | None = None
) -> list:
    """Sublinear, smoothed, unit-length TF-IDF of one text column; ``max_df`` below 1 is a share of the documents."""
    limits = {"minDF": min_df, **({} if max_df is None else {"maxDF": max_df})}
    return [
        Terms(inputCol=column, outputCol=f"_{output}_terms", analyzer=analyzer),
        TfidfVocabulary(inputCol=f"_{output}_terms", outputCol=output, vocabSize=max_features, **limits),
    ]


def relevance_blocks(feature_set: str, query: str, product: str, pair: str) -> dict[str, list]:
    """Stages of the text blocks of a feature set (word, char or combined), by their output column."""
    blocks = {}
    if feature_set in ("word", "combined"):
        for column, size in ((query, 12_000), (product, 30_000), (pair, 30_000)):
            blocks[f"{column}_tfidf"] = text_stages(column, f"{column}_tfidf", "word", size)
    if feature_set in ("char", "combined"):
        blocks[f"{pair}_chars"] = text_stages(pair, f"{pair}_chars", "char", 20_000)
    return blocks


def relevance_stages(feature_set: str, query: str, product: str, pair: str, explicit: list[str], output: str = "features") -> list:
    """Text blocks of a feature set (word, char or combined) before the explicit columns."""
    blocks = relevance_blocks(feature_set, query, product, pair)
    return [*[stage for stages in blocks.values() for stage in stages], VectorAssembler(inputCols=[*blocks, *explicit], outputCol=output)]


def stored_blocks(df: DataFrame, key: list[str], fit: Column, blocks: dict[str, list]) -> DataFrame:
    """``df`` with the vectors of every block, fitted on the ``fit`` rows.

    Each block is made once and written, so that no later stage makes its terms
    again and no text passes through the stages of another block.
    """
    out = df
    for name, stages in blocks.items():
        column = stages[0].getInputCol()
        model = Pipeline(stages=stages).fit(df.where(fit).select(column))
        vectors = through_table(model.transform(df.select(*key, column)).select(*key, name), "block")
        out = out.join(vectors, key)
    return out


def stored_features(df: DataFrame, assembler: VectorAssembler, keep: list[str]) -> DataFrame:
    """Assembled vectors, written without the names of their slots.

    An assembler names every slot in the column's metadata, and an iterative
    fit sends that to its tasks once per iteration.
    """
    name = assembler.getOutputCol()
    return through_table(assembler.transform(df).select(*keep, name).withMetadata(name, {}), "features")


def univariate_selector(features: str, label: str, k: int = 8, output: str = "selected") -> UnivariateFeatureSelector:
    """The ``k`` features with the largest F statistic against a continuous label."""
    s = UnivariateFeatureSelector(featuresCol=features, outputCol=output, labelCol=label, selectionMode="numTopFeatures")
    return s.setFeatureType("continuous").setLabelType("continuous").setSelectionThreshold(k)


def feature_names(df: DataFrame, features: str) -> list[str]:
    """Names of vector slots from the column metadata."""
    attrs = df.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    slots = sorted((a["idx"], a.get("name", f"f{a['idx']}")) for group in attrs.values() for a in group)
    return [name for _, name in slots]


def importance_report(df: DataFrame, features: str, weights, names: list[str] | None = None) -> DataFrame:
    """``(feature, weight, magnitude, direction, position)`` of a fitted model."""
    values = [float(x) for x in (weights.toArray() if hasattr(weights, "toArray") else weights)]
    labels = names or feature_names(df, features) or [f"f{i}" for i in range(len(values))]
    rows = literal_rows(df.sparkSession, [(n, w) for n, w in zip(labels, values)], "feature string, weight double")
    report = rows.withColumns(
        {
            "magnitude": F.abs("weight"),
            "direction": F.when(F.col("weight") > 0, "raises").when(F.col("weight") < 0, "lowers").otherwise("none"),
        }
    )
    return top_k(report, len(values), [F.desc("magnitude"), F.asc("feature")], [], "position")


def top_terms(spark, vocabulary: list[str], weights, n: int = 30) -> DataFrame:
    """The ``n`` strongest terms in each direction; a vocabulary is bounded by its cap."""
    pairs = spark.createDataFrame([(t, float(w)) for t, w in zip(vocabulary, weights)], "term string, weight double")
    up = pairs.orderBy(F.desc("weight"), "term").limit(n).withColumn("side", F.lit("positive"))
    down = pairs.orderBy(F.asc("weight"), "term").limit(n).withColumn("side", F.lit("negative"))
    return up.unionByName(down)


# --- estimators ---------------------------------------------------------------------------


# Settings of the tree ensembles that results are compared under; callers may pass others.
CLASSIFIER_TREES = {
    "decision_tree": {"maxDepth": 8, "minInstancesPerNode": 10},
    "random_forest": {"numTrees": 300, "maxDepth": 12, "minInstancesPerNode": 4},
    "gradient_boosting": {"maxIter": 150, "stepSize": 0.05, "maxDepth": 3},
}
REGRESSOR_TREES = {
    "random_forest": {"numTrees": 120, "maxDepth": 18},
    "gradient_boosting": {"maxIter": 150, "stepSize": 0.05, "maxDepth": 3},
}


def classifier(name: str, features: str = "features", label: str = "label", weight: str | None = None, **settings):
    """Estimators by name; ``settings`` replace the defaults. Substitutes for algorithms Spark lacks are named in the README."""
    common = {"featuresCol": features, "labelCol": label, **({"weightCol": weight} if weight else {})}
    seeded = {"seed": SEED, **common}
    # A level starts where the one before it ended, instead of passing every row down every tree again; the trees are the same.
    kept_nodes = {"cacheNodeIds": True}
    kinds = {
        "logistic_regression": (LogisticRegression, {"maxIter": 100, "regParam": 0.01, **common}),
        "tuned_logistic": (LogisticRegression, {"maxIter": 100, "regParam": 0.02, **common}),
        "linear_svc": (LinearSVC, {"maxIter": 30, "tol": 1e-3, "regParam": 0.01, **common}),
        "naive_bayes": (NaiveBayes, {"modelType": "multinomial", "smoothing": 1.0, **common}),
        "decision_tree": (DecisionTreeClassifier, {**CLASSIFIER_TREES["decision_tree"], **seeded}),
        "random_forest": (RandomForestClassifier, {**CLASSIFIER_TREES["random_forest"], **kept_nodes, **seeded}),
        "extra_trees": (
            RandomForestClassifier, {**CLASSIFIER_TREES["random_forest"], **kept_nodes, "bootstrap": False, "featureSubsetStrategy": "sqrt", "maxBins": 8, **seeded}
        ),
        "gradient_boosting": (GBTClassifier, {**CLASSIFIER_TREES["gradient_boosting"], **seeded}),
        "sgd_log_loss": (LogisticRegression, {"maxIter": 20, "regParam": 1e-4, **common}),
        "sgd_modified_huber": (LinearSVC, {"maxIter": 20, "tol": 1e-3, "regParam": 1e-4, **common}),
    }
    kind, defaults = kinds[name]
    return kind(**{**defaults, **settings})


def regressor(name: str, features: str = "features", label: str = "label", **settings):
    """Regression estimators by name; ``settings`` replace the defaults."""
    common = {"featuresCol": features, "labelCol": label}
    kinds = {
        "linear": (LinearRegression, {"elasticNetParam": 0.0}),
        "ridge": (LinearRegression, {"elasticNetParam": 0.0, "regParam": 1.0}),
        "random_forest": (RandomForestRegressor, {**REGRESSOR_TREES["random_forest"], "seed": SEED}),
        "gradient_boosting": (GBTRegressor, {**REGRESSOR_TREES["gradient_boosting"], "seed": SEED}),
    }
    kind, defaults = kinds[name]
    return kind(**{**defaults, **common, **settings})


def balanced_weights(df: DataFrame, label: str, name: str = "class_weight") -> DataFrame:
    """Row weight ``n / (classes * rows of the class)`` for a 0/1 label."""
    n = df.agg(F.count(F.lit(1))).scalar()
    pos = df.agg(F.count_if(F.col(label) == 1)).scalar()
    return df.withColumn(name, F.when(F.col(label) == 1, F.try_divide(n, 2 * pos)).otherwise(F.try_divide(n, 2 * (n - pos))))


def prior_scores(train: DataFrame, df: DataFrame, label: str, name: str = "score") -> DataFrame:
    """The training positive rate as every row's score."""
    return df.withColumn(name, train.agg(F.avg(F.col(label).cast("double"))).scalar())


def positive_score(scored: DataFrame) -> Column:
    """Probability of class 1, or the margin for models without probabilities."""
    if "probability" in scored.columns:
        return vector_to_array("probability")[1]
    return vector_to_array("rawPrediction")[1]


def with_scores(model: PipelineModel, df: DataFrame, name: str = "score") -> DataFrame:
    scored = model.transform(df)
    return scored.select(*df.columns, F.col("prediction").cast("int").alias("prediction"), positive_score(scored).alias(name))


# --- evaluation and search ----------------------------------------------------------------


def classification_summary(scored: DataFrame, label: str, score: str = "score") -> DataFrame:
    """One row of threshold and ranking metrics for a scored table.

    Label, prediction and score are written once, so the model runs one time
    however many metrics read its output.
    """
    scored = through_table(scored.select(label, "prediction", score), "scored")
    basics = binary_metrics(scored, label, "prediction").drop("support", "positive_rate")
    areas = ranking_areas(scored, label, score)
    return basics.select("*", areas.select("roc_auc").scalar().alias("roc_auc"), areas.select("average_precision").scalar().alias("average_precision"))


def cross_validate(df: DataFrame, candidates: dict[str, list], label: str, fold: str, folds: int, shared: list | None = None) -> DataFrame:
    """``(model, fold, metrics…)``: one fit per candidate and fold, each a cluster job.

    ``shared`` are stages that all candidates begin with; they are fitted once per fold.
    """
    out = None
    for i in range(folds):
        train, held = _fold_parts(df, shared or [], fold, i)
        for name, stages in candidates.items():
            scored = with_scores(Pipeline(stages=stages).fit(train), held)
            row = classification_summary(scored, label).select(F.lit(name).alias("model"), F.lit(i).alias("fold"), "*")
            out = row if out is None else out.unionByName(row)
        train.unpersist()
        held.unpersist()
    return out


def _fold_parts(df: DataFrame, stages: list, fold: str, i: int) -> tuple[DataFrame, DataFrame]:
    """Training and held-out rows of a fold through ``stages`` fitted on the training rows; both stay until they are let go."""
    train, held = df.where(F.col(fold) != i), df.where(F.col(fold) == i)
    model = Pipeline(stages=stages).fit(train)
    return model.transform(train).persist(), model.transform(held).persist()


def cv_summary(results: DataFrame, metrics: list[str], by: str = "model") -> DataFrame:
    """Mean and population standard deviation over folds."""
    return results.groupBy(by).agg(
        *[x for m in metrics for x in (F.round(F.avg(m), 6).alias(f"{m}_mean"), F.round(F.stddev_pop(m), 6).alias(f"{m}_std"))]
    )


def grid_search(df: DataFrame, stages: list, grid: list[dict], evaluator, fold: str, folds: int, parallelism: int = 4):
    """Cross-validated grid with a fixed fold column; returns the best model and the table.

    Stages before the first one with a parameter of the grid are the same for all settings and are fitted once per fold.
    """
    builder = ParamGridBuilder()
    for param, values in grid:
        builder = builder.addGrid(param, values)
    maps = builder.build()
    owners = {p.parent for m in maps for p in m}
    first = next((n for n, stage in enumerate(stages) if stage.uid in owners), len(stages))
    rest, values = Pipeline(stages=stages[first:]), np.zeros((folds, len(maps)))
    for i in range(folds):
        train, held = _fold_parts(df, stages[:first], fold, i)

        def measured(m, train=train, held=held) -> float:
            return evaluator.evaluate(rest.fit(train, m).transform(held, m))

        with ThreadPoolExecutor(min(parallelism, len(maps))) as pool:
            values[i] = list(pool.map(inheritable_thread_target(df.sparkSession)(measured), maps))
        train.unpersist()
        held.unpersist()
    means, larger = values.mean(axis=0), evaluator.isLargerBetter()
    rows = [
        (json.dumps({p.name: v for p, v in m.items()}, sort_keys=True), float(a), float(s)) for m, a, s in zip(maps, means, values.std(axis=0))
    ]
    table = literal_rows(df.sparkSession, rows, "params string, mean_value double, std_value double")
    order = F.desc("mean_value") if larger else F.asc("mean_value")
    best_model = Pipeline(stages=stages).fit(df, maps[int(np.argmax(means) if larger else np.argmin(means))])
    return best_model, top_k(table, len(rows), [order, F.asc("params")], [], "position")


def retrain_and_test(train: DataFrame, validation: DataFrame, test: DataFrame, stages: list, label: str) -> DataFrame:
    """Fit on train and validation together, then one evaluation on the test rows."""
    model = Pipeline(stages=stages).fit(train.unionByName(validation))
    return classification_summary(with_scores(model, test), label)


def out_of_fold(df: DataFrame, stages: list, key: str, fold: str, folds: int, name: str = "oof") -> DataFrame:
    """Scores of rows by models that never saw their fold, joined by key."""
    parts = None
    for i in range(folds):
        model = Pipeline(stages=stages).fit(df.where(F.col(fold) != i))
        part = with_scores(model, df.where(F.col(fold) == i), name).select(key, name)
        parts = part if parts is None else parts.unionByName(part)
    return df.join(through_table(parts, "oof"), key)


def fit_platt(scored: DataFrame, score: str, label: str) -> PipelineModel:
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=[score], outputCol="_margin"),
            LogisticRegression(featuresCol="_margin", labelCol=label, predictionCol="_p", probabilityCol="_prob", rawPredictionCol="_raw"),
        ]
    ).fit(scored)


def apply_platt(model: PipelineModel, df: DataFrame, name: str = "calibrated") -> DataFrame:
    return model.transform(df).withColumn(name, vector_to_array("_prob")[1]).drop("_margin", "_p", "_prob", "_raw")


def fit_isotonic(scored: DataFrame, score: str, label: str):
    prepared = scored.select(F.col(score).cast("double").alias("_x"), F.col(label).cast("double").alias("_y"))
    return IsotonicRegression(featuresCol="_x", labelCol="_y", predictionCol="calibrated").fit(prepared)


def apply_isotonic(model, df: DataFrame, score: str, name: str = "calibrated") -> DataFrame:
    fitted = model.copy({model.predictionCol: name})
    return fitted.transform(df.withColumn("_x", F.col(score).cast("double"))).drop("_x")


def calibration_summary(scored: DataFrame, label: str, score: str, name: str) -> DataFrame:
    return probability_losses(scored, label, score).select(F.lit(name).alias("method"), "*")


def regression_summary(model: PipelineModel, test: DataFrame, label: str) -> DataFrame:
    return regression_metrics(model.transform(test), label, "prediction")


# --- learning to rank ----------------------------------------------------------------------


def ranking_pairs(df: DataFrame, group: str, item: str, label: str, features: list[str], per_item: int = 4, seed: int = SEED) -> DataFrame:
    """Feature differences of each positive and ``per_item`` negatives of its group.

    Positives and negatives are numbered in digest order; positive ``r`` meets
    negatives ``per_item * r …`` modulo their number. That is an equality join
    on (group, number): work grows with the positives, never with the square
    of a group, and a huge group spreads over its numbers.
    """
    base = df.select(group, item, F.col(label).alias("_y"), *features)
    ranked = rank_by_hash(base, [item], seed, "_r", [group, "_y"]).withColumn("_r", F.col("_r") - 1)
    sizes = df.groupBy(group).agg(F.count_if(F.col(label) == 0).alias("_m"), F.count(F.lit(1)).alias("_n"))
    positives = join_groups(ranked.where("_y = 1"), sizes.where("_m > 0"), [group], "_n")
    asked = positives.withColumn("_i", F.explode(F.sequence(F.lit(0), F.least(F.lit(per_item), F.col("_m")).cast("int") - 1))).select(
        group,
        F.col(item).alias("positive"),
        F.pmod(F.col("_r") * per_item + F.col("_i"), F.col("_m")).alias("_at"),
        *[F.col(f).alias(f"_p_{f}") for f in features],
    )
    negatives = ranked.where("_y = 0").select(group, F.col("_r").alias("_at"), F.col(item).alias("negative"), *[F.col(f).alias(f"_n_{f}") for f in features])
    joined = asked.join(negatives, [group, "_at"])
    return joined.select(group, "positive", "negative", *[(F.col(f"_p_{f}") - F.col(f"_n_{f}")).alias(f"d_{f}") for f in features])


def fit_pairs(pairs: DataFrame, features: list[str]) -> PipelineModel:
    """Linear ranker on the differences ``d_*`` of pairs, each taken both ways, weighted by ``pair_weight``."""
    signed = pairs.withColumn("_sign", F.explode(F.array(F.lit(1.0), F.lit(-1.0)))).select(
        *[(F.col(f"d_{f}") * F.col("_sign")).alias(f) for f in features], ((F.col("_sign") + 1) / 2).alias("_better"), "pair_weight"
    )
    stages = [
        VectorAssembler(inputCols=features, outputCol="_diff"),
        LogisticRegression(featuresCol="_diff", labelCol="_better", weightCol="pair_weight", fitIntercept=False, regParam=1e-3, maxIter=50),
    ]
    return Pipeline(stages=stages).fit(signed)


def apply_ranker(model: PipelineModel, df: DataFrame, features: list[str], name: str = "rank_score") -> DataFrame:
    """Linear score of every row; the learned weights are a handful of literals."""
    weights = model.stages[-1].coefficients.toArray()
    total = F.lit(0.0)
    for f, w in zip(features, weights):
        total = total + F.col(f).cast("double") * float(w)
    return df.withColumn(name, total)


# --- persistence ---------------------------------------------------------------------------


def save_model(model: PipelineModel, path: str, metadata: dict) -> None:
    """Pipeline and a one-row metadata table side by side."""
    model.write().overwrite().save(f"{path}/model")
    literal_rows(_active(), [(json.dumps(metadata, sort_keys=True),)], "metadata string").write.mode("overwrite").parquet(f"{path}/metadata")


def load_model(spark, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.parquet(f"{path}/metadata").first()[0])


def _active():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()

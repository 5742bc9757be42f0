"""Fitted pair features, stacked scores, cross-fitted calibration and iterated ranking.

What is fitted here is too large for parameters: counts of every query and
item, codes, vocabularies. It is kept as tables and saved as Parquet.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import scratch_path, through_table
from . import features as X
from . import models as D
from .ordered import rank_by_value, running_in_order

# The columns that are counted and coded, and the sizes of the two vocabularies.
COUNTED = ["query", "item_id", "category", "brand"]
CODED = ["category", "brand", "gender", "age_group"]
VOCABULARIES = {"word": (2, 30_000), "char": (1, 25_000)}


class _TableWriter(MLWriter):
    """Parameters as metadata, tables as Parquet beside them."""

    def __init__(self, instance: DenseFeaturesModel) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        for name, table in self.instance.tables().items():
            table.write.parquet(f"{path}/tables/{name}")


class _TableReader(MLReader):
    def load(self, path: str) -> DenseFeaturesModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = DenseFeaturesModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model.over(f"{path}/tables")


class _Roles(Params):
    counted = Param(Params._dummy(), "counted", "columns with a training frequency", TypeConverters.toListString)
    coded = Param(Params._dummy(), "coded", "columns with a code and a missing flag", TypeConverters.toListString)


class DenseFeatures(Estimator, _Roles, MLWritable, MLReadable):
    """Similarity of query and product, two TF-IDF cosines, codes and training frequencies.

    Input columns: query, title, category, brand, attributes and those of
    ``counted`` and ``coded``. A missing value is a level of its own; a value
    that training did not see has code and frequency 0. Vocabularies come from
    the normalised queries and titles of the training rows.
    """

    @keyword_only
    def __init__(self, *, counted=None, coded=None):
        super().__init__()
        self._setDefault(counted=COUNTED, coded=CODED)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> DenseFeaturesModel:
        counted, coded = self.getOrDefault(self.counted), self.getOrDefault(self.coded)
        home = scratch_path(dataset.sparkSession, "dense-features")
        every = list(dict.fromkeys([*counted, *coded]))
        level = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _level(c).alias("value")) for c in every]))
        levels = dataset.select(level.alias("e")).groupBy("e.column", "e.value").agg(F.count(F.lit(1)).alias("n"))
        rank_by_value(levels, "n", "value", "code", ["column"]).write.parquet(f"{home}/levels")
        texts = dataset.select(F.explode(F.array(T.normalize_basic("query"), T.normalize_basic("title"))).alias("text"))
        texts = texts.select(F.xxhash64("text").alias("key"), "text").groupBy("key", "text").agg(F.count(F.lit(1)).alias("rows"))
        texts = through_table(texts, "texts")
        size = texts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("documents"))
        for name, (ngrams, most) in VOCABULARIES.items():
            counts = X.term_counts(texts, "key", "text", name, ngrams).join(texts.select("key", "rows"), "key")
            terms = counts.groupBy("term").agg(F.sum("rows").alias("df"), F.sum(F.col("tf") * F.col("rows")).alias("cf")).where("df >= 2")
            terms.orderBy(F.desc("cf"), "term").limit(most).crossJoin(F.broadcast(size)).write.parquet(f"{home}/{name}")  # one size row
        return DenseFeaturesModel(counted=counted, coded=coded).over(home)

    def write(self) -> MLWriter:
        return DefaultParamsWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return DefaultParamsReader(cls)


def _level(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


class DenseFeaturesModel(Model, _Roles, MLWritable, MLReadable):
    """The fitted stage; its state is the tables below one folder."""

    @keyword_only
    def __init__(self, *, counted=None, coded=None):
        super().__init__()
        self._setDefault(counted=COUNTED, coded=CODED)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        self.home = ""

    def over(self, home: str) -> DenseFeaturesModel:
        self.home = home
        return self

    def tables(self) -> dict[str, DataFrame]:
        from pyspark.sql import SparkSession

        spark = SparkSession.active()
        return {name: spark.read.parquet(f"{self.home}/{name}") for name in ("levels", *VOCABULARIES)}

    def names(self) -> list[str]:
        """The feature columns, in order."""
        codes = [f"{c}_{kind}" for c in self.getOrDefault(self.coded) for kind in ("code", "missing")]
        return [*X.PAIR_FEATURES, "word_cosine", "char_cosine", *codes, *[f"{c}_train_frequency" for c in self.getOrDefault(self.counted)]]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """The rows of ``dataset`` with one column per feature."""
        tables = self.tables()
        out = X.pair_features(dataset, "query", "title", "category", "brand", "attributes")
        out = out.withColumns({"_l": T.normalize_basic("query"), "_r": T.normalize_basic("title")})
        out = out.withColumn("_pair", F.sha2(F.concat_ws("\x01", "_l", "_r"), 256))
        texts = through_table(out.select("_pair", "_l", "_r").dropDuplicates(["_pair"]), "pair-texts")
        for name, (ngrams, _) in VOCABULARIES.items():
            cosine = X.cosine_under(texts, "_pair", "_l", "_r", tables[name], F.max("documents"), name, ngrams)
            out = out.join(cosine.withColumnRenamed("cosine", f"{name}_cosine"), "_pair", "left")
        coded, counted = self.getOrDefault(self.coded), self.getOrDefault(self.counted)
        for c in dict.fromkeys([*coded, *counted]):
            wanted = {f"{c}_code": "code"} if c in coded else {}
            wanted |= {f"{c}_train_frequency": "n"} if c in counted else {}
            level = tables["levels"].where(F.col("column") == c).select(F.col("value").alias("_level"), *[F.col(v).alias(k) for k, v in wanted.items()])
            out = out.join(level, _level(c) == F.col("_level"), "left").drop("_level")
            out = out.withColumns({k: F.coalesce(k, F.lit(0)) for k in wanted})
            if c in coded:
                out = out.withColumn(f"{c}_missing", (_level(c) == "").cast("int"))
        return out.select(*[F.col(c) for c in dataset.columns], *[F.col(c).cast("double").alias(c) for c in self.names()])

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader()


# --- stacking ------------------------------------------------------------------------------


def stacked_scores(
    train: DataFrame, others: dict[str, DataFrame], bases: dict[str, list], key: str, fold: str, folds: int
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Scores of the base models as columns of their own.

    A training row is scored by models that were fitted without its fold; rows
    of the other tables by models of all training rows. So no row is scored by a
    model that saw it. ``bases`` maps a column to the stages that make it.
    """
    level, rest = train, dict(others)
    for name, stages in bases.items():
        level = D.out_of_fold(level, stages, key, fold, folds, name)
        whole = Pipeline(stages=stages).fit(train)
        for part, rows in rest.items():
            rest[part] = through_table(_scored(whole, rows, name), "stacked")
    return through_table(level, "stacked"), rest


def _scored(model, rows: DataFrame, name: str) -> DataFrame:
    scored = model.transform(rows)
    return scored.select(*[F.col(c) for c in rows.columns], D.positive_score(scored).alias(name))


def two_levels(train: DataFrame, holdout: DataFrame, bases: dict[str, list], final, key: str, label: str, fold: str, folds: int) -> DataFrame:
    """One row of metrics per base model and one for the model stacked on them, all on the holdout.

    ``final`` makes the stages of the second level from the names of the score columns.
    """
    level, others = stacked_scores(train, {"holdout": holdout}, bases, key, fold, folds)
    rows, out = others["holdout"], None
    for name, stages in bases.items():
        scored = D.with_scores(Pipeline(stages=stages).fit(train), holdout)
        row = D.classification_summary(scored, label).select(F.lit(1).alias("level"), F.lit(name).alias("model"), "*")
        out = row if out is None else out.unionByName(row)
    second = Pipeline(stages=final(list(bases))).fit(level)
    top = D.classification_summary(D.with_scores(second, rows), label).select(F.lit(2).alias("level"), F.lit("stacked").alias("model"), "*")
    return out.unionByName(top)


# --- calibration ---------------------------------------------------------------------------


def cross_calibrated(train: DataFrame, rows: DataFrame, stages: list, label: str, fold: str, folds: int, method: str, name: str = "calibrated") -> DataFrame:
    """Mean of ``folds`` calibrated models, each with its own calibrator.

    Model i is fitted without fold i and its calibrator on the scores of fold i.
    ``rows`` must not be part of ``train``.
    """
    out = rows.select("*", F.lit(0.0).alias(name))
    for i in range(folds):
        model = Pipeline(stages=stages).fit(train.where(F.col(fold) != i))
        held = through_table(D.with_scores(model, train.where(F.col(fold) == i), "_uncalibrated").select(label, "_uncalibrated"), "margins")
        scored = D.with_scores(model, out, "_uncalibrated").drop("prediction")
        if method == "sigmoid":
            one = D.apply_platt(D.fit_platt(held, "_uncalibrated", label), scored, "_one")
        else:
            one = D.apply_isotonic(D.fit_isotonic(held, "_uncalibrated", label), scored, "_uncalibrated", "_one")
        out = one.withColumn(name, F.col(name) + F.col("_one") / folds).drop("_one", "_uncalibrated")
    return out


# --- ranking -------------------------------------------------------------------------------


def ranked_state(df: DataFrame, group: str, item: str, label: str, score: str) -> DataFrame:
    """Current ranks with hits and the sum of 1 / rank over the hits so far, per group of any size."""
    hit = (F.col(label) == 1).cast("double")
    ranked = rank_by_value(df, score, item, "_at", [group], extra={"_c": hit})
    return running_in_order(ranked, [F.asc("_at")], {"_s": hit / F.col("_at")}, [group])


def weighted_pairs(
    df: DataFrame, group: str, item: str, label: str, features: list[str], score: str, objective: str, top: int | None = None, per_item: int = 4
) -> DataFrame:
    """Feature differences of positives and negatives, weighted by what swapping them would change.

    Without ``top`` a positive meets ``per_item`` negatives in digest order. With
    it, only pairs that touch the first ``top`` ranks count: positives meet the
    negatives among these, and positives among these meet ``per_item`` others.
    """
    own = ["_at", "_c", "_s"]
    state = through_table(ranked_state(df.select(group, item, label, *features, score), group, item, label, score), "ranked")
    hits = state.where(F.col(label) == 1).groupBy(group).agg(F.count(F.lit(1)).alias("_hits"))
    carried = [*features, *own]
    if top is None:
        pairs = D.ranking_pairs(_sided(state, label, own), group, item, label, [*features, *_sides(own)], per_item)
    else:
        sided = _sided(state, label, own)
        near = D.ranking_pairs(sided.where((F.col(label) == 0) | (F.col("_at") <= top)), group, item, label, [*features, *_sides(own)], per_item)
        slots = F.explode(F.sequence(F.lit(1), F.lit(top))).alias("_slot")
        left = state.where(F.col(label) == 1).select(group, F.col(item).alias("positive"), *[F.col(c).alias(f"p_{c}") for c in carried], slots)
        right = state.where((F.col(label) == 0) & (F.col("_at") <= top)).select(
            group, F.col(item).alias("negative"), *[F.col(c).alias(f"n_{c}") for c in carried], F.col("_at").alias("_slot")
        )
        met = left.join(right, [group, "_slot"])
        high = met.select(
            group, "positive", "negative", *[(F.col(f"p_{f}") - F.col(f"n_{f}")).alias(f"d_{f}") for f in features],
            *[F.col(f"p_{c}").cast("double").alias(f"d_{c}_p") for c in own], *[(-F.col(f"n_{c}")).cast("double").alias(f"d_{c}_n") for c in own],
        )
        # A pair found both ways counts once.
        pairs = near.select(high.columns).unionByName(high).dropDuplicates([group, "positive", "negative"])
    pairs = pairs.join(hits, group)
    value = {c: F.col(f"d_{c}") if c.endswith("_p") else -F.col(f"d_{c}") for c in _sides(own)}
    p, q = value["_at_p"], value["_at_n"]
    if objective == "ndcg":
        ideal = F.aggregate(F.sequence(F.lit(1), F.col("_hits").cast("int")), F.lit(0.0), lambda s, k: s + 1 / F.log2(k + 1.0))
        weight = F.abs(1 / F.log2(p + 1) - 1 / F.log2(q + 1)) / ideal
    elif objective == "map":
        rises = (value["_c_n"] + 1) / q + (value["_s_p"] - 1 / p - value["_s_n"]) - value["_c_p"] / p
        falls = value["_c_p"] / p + (value["_s_n"] - value["_s_p"]) - value["_c_n"] / q
        weight = F.when(q < p, rises).otherwise(falls) / F.col("_hits")
    else:
        weight = F.lit(1.0)
    return pairs.select(
        group, "positive", "negative", *[f"d_{f}" for f in features], p.alias("rank_pos"), q.alias("rank_neg"), (weight + F.lit(1e-6)).alias("pair_weight")
    )


def _sides(own: list[str]) -> list[str]:
    return [f"{c}{mark}" for c in own for mark in ("_p", "_n")]


def _sided(state: DataFrame, label: str, own: list[str]) -> DataFrame:
    """A figure once for positives and once for negatives, so that differences give both back."""
    sides = {f"{c}{mark}": F.when(F.col(label) == y, F.col(c)).otherwise(0.0) for c in own for mark, y in (("_p", 1), ("_n", 0))}
    return state.withColumns(sides)


def fit_ranking_rounds(
    df: DataFrame, group: str, item: str, label: str, features: list[str], score: str, objective: str, top: int | None = None, rounds: int = 3
):
    """A linear ranker fitted in rounds: each ranks by the model before it (first by ``score``) and weighs the pairs anew."""
    current, model = df.withColumn("_score", F.col(score).cast("double")), None
    for _ in range(rounds):
        pairs = weighted_pairs(current, group, item, label, features, "_score", objective, top)
        model = D.fit_pairs(through_table(pairs, "pairs"), features)
        current = D.apply_ranker(model, df, features, "_score")
    return model

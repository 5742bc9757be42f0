"""Batch scoring: stateless, so the same functions serve streaming frames."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import as_column, recode
from .clean import BAND_CUTS_SERVICE, risk_band
from .models import with_scores
from .ordered import top_k

SIGNALS = ["jaccard", "query_coverage", "title_coverage", "brand_mention", "category_overlap"]
USD_PER_UNIT = 100_000  # fixed value: housing targets are in hundreds of thousands


def margin_confidence(margin: str | Column) -> Column:
    return 1 / (1 + F.exp(-F.abs(as_column(margin))))


def class_confidence(probability: str | Column) -> Column:
    p = as_column(probability)
    return F.greatest(p, 1 - p)


def score_customers(model: PipelineModel, df: DataFrame, cuts: list[float] = BAND_CUTS_SERVICE, version: str = "1") -> DataFrame:
    """Source columns plus prediction, probability, risk band and model version."""
    out = with_scores(model, df, "probability_of_churn")
    return out.withColumns({"risk_band": risk_band("probability_of_churn", cuts), "model_version": F.lit(version)})


def score_values(model: PipelineModel, df: DataFrame, name: str = "predicted_value") -> DataFrame:
    scored = model.transform(df)
    return scored.select(*df.columns, F.col("prediction").alias(name), (F.col("prediction") * USD_PER_UNIT).alias(f"{name}_usd"))


def score_sentiment(model: PipelineModel, df: DataFrame) -> DataFrame:
    out = with_scores(model, df, "score")
    return out.withColumns({"sentiment": recode("prediction", {1: "positive", 0: "negative"}), "confidence": class_confidence("score")})


def score_relevance(model: PipelineModel, df: DataFrame, score_type: str | None = None) -> DataFrame:
    """Scores and labels; ``score_type`` tells what the score is: a probability, or the margin of models without one."""
    known = "probability" if "probability" in model.transform(df.limit(0)).columns else "margin"
    if score_type not in (None, known):
        raise ValueError(f"the model gives a {known}, not a {score_type}")
    score_type = known
    out = with_scores(model, df, "relevance_score")
    return out.withColumns({"score_type": F.lit(score_type), "relevance": recode("prediction", {1: "relevant", 0: "not relevant"})})


def rank_catalogue(model: PipelineModel, candidates: DataFrame, query: str, doc: str, k: int = 10) -> DataFrame:
    """Candidates of each query ordered by classifier score."""
    scored = with_scores(model, candidates, "relevance_score").withColumn("relevance_score", F.round("relevance_score", 9))
    return top_k(scored, k, [F.desc("relevance_score"), F.asc(doc)], [query])


def with_signals(df: DataFrame, keys: list[str], score: Column) -> DataFrame:
    """Score next to the matching signals that explain it."""
    return df.select(*keys, score.alias("score"), *SIGNALS)

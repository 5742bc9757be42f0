"""A corpus pipeline over ``documents``: each stage is one operator of ``veriloom.llm``.

Every stage takes the table that its predecessor wrote. All but the last return
the columns of ``documents``; rewritten texts bring ``n_chars`` up to date.
Null and empty texts go in the first stage; repeated rows, ties and clashing
extra columns are handled as the operators state; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.llm import decontaminate, jaccard, mixing, quality, sharding
from veriloom.session import through_table


def _rewritten(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with ``clean_text`` as text."""
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that failed."""
    return _rewritten(quality.judge_lines(docs).where("kept"), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies."""
    return jaccard.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark spans; documents of which nothing is left go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.decontaminate(docs, benchmark)
    return _rewritten(found.where("not contaminated or clean_text rlike '[^\\\\x20\\\\x09-\\\\x0D]'"), docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents so that sources meet their target weights, in shuffled order."""
    return mixing.mix(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot in it; equal texts share a shard."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontaminated),
    ("mixing to target weights", mixed),
    ("sharding", sharded),
]
#: The join's components and the rewritten texts have no plain SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = through_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

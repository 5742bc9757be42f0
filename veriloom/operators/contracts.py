"""Checks on tables, returned as small report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scalars import as_column, blank_to_empty, flag, is_true, to_number
from ..functions.vectors import all_finite, norm
from .ordered import keep_first


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``(check_name, n_bad)`` for all rules in one pass."""
    wide = df.agg(*[F.count_if(is_true(c)).alias(f"r{i}") for i, c in enumerate(rules.values())])
    pairs = F.array(
        *[F.struct(F.lit(n).alias("check_name"), F.col(f"r{i}").alias("n_bad")) for i, n in enumerate(rules)]
    )
    return wide.select(F.explode(pairs).alias("p")).select("p.*")


def source_report(df: DataFrame, required: list[str]) -> DataFrame:
    """Missing columns, rows, files, bytes and newest change of a file source."""
    missing = [c for c in required if c not in df.columns]
    per_file = df.groupBy(
        F.col("_metadata.file_path").alias("p"),
        F.col("_metadata.file_size").alias("s"),
        F.col("_metadata.file_modification_time").alias("m"),
    ).agg(F.count(F.lit(1)).alias("n"))
    return per_file.agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("files"),
        F.sum("s").alias("size_bytes"),
        F.max("m").alias("modified_at"),
    ).withColumn("missing_columns", F.lit(",".join(missing)))


def domain_rules(label: str, domain: list, weight: str | None = None) -> dict[str, Column]:
    rules = {"label_outside_domain": ~F.col(label).isin(domain) | F.col(label).isNull()}
    if weight:
        rules["negative_weight"] = F.col(weight) < 0
    return rules


def batch_input_report(df: DataFrame, required: list[str], numeric: list[str]) -> DataFrame:
    """``(check_name, column_name, n_bad)``: missing columns, empty table, bad numbers."""
    present = [c for c in numeric if c in df.columns]
    wide = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(to_number(c).isNull()).alias(f"bad_{c}") for c in present],
    )
    entries = [
        F.struct(F.lit("missing_column").alias("check_name"), F.lit(c).alias("column_name"), F.lit(1).cast("long").alias("n_bad"))
        for c in required
        if c not in df.columns
    ]
    entries.append(
        F.struct(
            F.lit("empty_table").alias("check_name"),
            F.lit("").alias("column_name"),
            (F.col("n") == 0).cast("long").alias("n_bad"),
        )
    )
    entries += [
        F.struct(
            F.lit("not_numeric").alias("check_name"), F.lit(c).alias("column_name"), F.col(f"bad_{c}").alias("n_bad")
        )
        for c in present
    ]
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def with_text_defaults(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing optional text columns become ``''``; all are cast to text."""
    extra = {c: blank_to_empty(c) if c in df.columns else F.lit("") for c in columns}
    return df.withColumns(extra)


def blank_text_report(df: DataFrame, required: list[str]) -> DataFrame:
    return violations(df, {f"blank_{c}": F.trim(blank_to_empty(c)) == "" for c in required})


def prepare_catalogue(df: DataFrame, key: str, order: list[str], text_columns: list[str]) -> DataFrame:
    """Unique non-null keys, blanks as ``''`` with ``*_missing`` flags, no empty entries."""
    first = keep_first(df.where(F.col(key).isNotNull()), [key], order)
    filled = first.withColumns({c: blank_to_empty(c) for c in text_columns})
    flags = {f"{c}_missing": flag(F.trim(F.col(c)) == "") for c in text_columns}
    # An entry whose texts normalise to nothing cannot be found by a search.
    searchable = reduce(lambda a, b: a | b, [T.normalize_search(c) != "" for c in text_columns])
    return filled.withColumns(flags).where(searchable)


def judgment_report(judgments: DataFrame, catalogue: DataFrame, group: str, item: str, label: str) -> DataFrame:
    """Rows, groups, duplicate pairs, positives and their presence in the catalogue."""
    pairs = judgments.groupBy(group, item).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos")
    )
    known = catalogue.select(F.col(item)).distinct().withColumn("_known", F.lit(1))
    return (
        pairs.join(known, item, "left")
        .groupBy(group)
        .agg(
            F.sum("n").alias("n"),
            F.count_if(F.col("n") > 1).alias("dup"),
            F.sum("pos").alias("pos"),
            F.sum(F.when(F.col("_known").isNotNull(), F.col("pos")).otherwise(0)).alias("found"),
        )
        .agg(
            F.sum("n").alias("rows"),
            F.count(F.lit(1)).alias("groups"),
            F.sum("dup").alias("duplicate_pairs"),
            F.sum("pos").alias("positives"),
            F.round(F.try_divide(F.sum("found"), F.sum("pos")), 6).alias("positive_availability"),
        )
    )


def content_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Order-independent digest of a table.

    Each row is hashed; four 32-bit lanes of the digests are summed, so the
    work is a plain map-side-combined aggregate at any size, and repeated rows
    still count.
    """
    # Each value goes with its length, a null with none, so neither separators nor stand-ins can be mistaken.
    texts = [as_column(c).cast("string") for c in columns]
    row = F.md5(F.concat(*[F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-;")) for x in texts]))
    lanes = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    return df.agg(F.count(F.lit(1)).alias("rows"), *[lane.alias(f"l{i}") for i, lane in enumerate(lanes)]).select(
        "rows", F.sha2(F.concat_ws("|", F.col("rows").cast("string"), "l0", "l1", "l2", "l3"), 256).alias("fingerprint")
    )


def embedding_report(df: DataFrame, vector: str, dimension: int) -> DataFrame:
    """Row count, bad rows and norm statistics in one pass."""
    n = norm(vector)
    return df.select(
        (F.size(vector) != dimension).alias("wrong_size"), (~all_finite(vector)).alias("bad"), n.alias("norm")
    ).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("wrong_size").alias("wrong_dimension"),
        F.count_if("bad").alias("not_finite"),
        F.count_if(F.abs(F.col("norm") - 1) > 1e-3).alias("not_unit"),
        F.round(F.min("norm"), 4).alias("norm_min"),
        F.round(F.avg("norm"), 4).alias("norm_mean"),
        F.round(F.max("norm"), 4).alias("norm_max"),
    )


def id_alignment(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Keys present on one side only, counted per side."""
    a = left.select(F.col(left_key).alias("k")).distinct().withColumn("l", F.lit(1))
    b = right.select(F.col(right_key).alias("k")).distinct().withColumn("r", F.lit(1))
    return a.join(b, "k", "full").agg(
        F.count_if(F.col("r").isNull()).alias("only_left"),
        F.count_if(F.col("l").isNull()).alias("only_right"),
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both_sides"),
    )

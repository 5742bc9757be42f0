"""Table profiles and data-quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import any_of, flag, literal_rows
from .ordered import exact_quantiles, quantile_values, singleton, top_k

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t.startswith(NUMERIC_TYPES)]


def other_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if not t.startswith(NUMERIC_TYPES)]


def _per_column(wide: DataFrame, columns: list[str], measures: dict[str, str]) -> DataFrame:
    """Turn one wide aggregate row (``{prefix}_{i}``) into one row per column."""
    entries = [
        F.struct(
            F.lit(c).alias("column_name"), *[F.col(f"{prefix}_{i}").alias(name) for name, prefix in measures.items()]
        )
        for i, c in enumerate(columns)
    ]
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def missing_counts(df: DataFrame) -> DataFrame:
    """Nulls per column, count and percent, most first."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n_{i}") for i, c in enumerate(df.columns)], F.count(F.lit(1)).alias("rows"))
    wide = wide.withColumns(
        {f"p_{i}": F.round(F.try_divide(F.col(f"n_{i}") * 100.0, F.col("rows")), 6) for i in range(len(df.columns))}
    )
    out = _per_column(wide, df.columns, {"n_missing": "n", "pct_missing": "p"})
    return out.orderBy(F.desc("n_missing"), "column_name")


def type_summary(df: DataFrame) -> DataFrame:
    """Position, type, kind and number of values of every column."""
    numeric = set(numeric_columns(df))
    rows = [(i, c, t, "numeric" if c in numeric else "categorical") for i, (c, t) in enumerate(df.dtypes)]
    types = literal_rows(df.sparkSession, rows, "position int, column_name string, dtype string, kind string")
    wide = df.agg(*[F.count(c).alias(f"n_{i}") for i, c in enumerate(df.columns)])
    return types.join(_per_column(wide, df.columns, {"n_values": "n"}), "column_name")


def cardinality(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column, exactly or by a mergeable sketch."""
    if approximate:
        wide = df.agg(*[F.approx_count_distinct(c).alias(f"n_{i}") for i, c in enumerate(df.columns)])
        return _per_column(wide, df.columns, {"n_unique": "n"})
    return _distinct_counts({"": df}).drop("table_name")


def _distinct_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, column_name, n_unique`` from one scan per table and one shuffle.

    A value travels as 128 bits of digest with the number of its column, and
    each task drops its own repeats before the shuffle, so a column costs its
    distinct values, whatever their length.
    """
    cells, columns = None, []
    for name, df in tables.items():
        entries = []
        for c in df.columns:
            value = F.col(c)
            mark = F.struct(F.lit(len(columns)).alias("at"), F.xxhash64(value).alias("h"), F.xxhash64(F.lit(1), value).alias("g"))
            entries.append(F.when(value.isNotNull(), mark))
            columns.append((len(columns), name, c))
        part = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where("at is not null")
        cells = part if cells is None else cells.unionByName(part)
    counts = cells.distinct().groupBy("at").agg(F.count(F.lit(1)).alias("n"))
    names = literal_rows(next(iter(tables.values())).sparkSession, columns, "at int, table_name string, column_name string")
    return names.join(counts, "at", "left").select("table_name", "column_name", F.coalesce("n", F.lit(0)).alias("n_unique"))


def value_frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_name, value, n)`` over non-null values as text."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    return (
        df.select(F.explode(pairs).alias("p"))
        .select("p.*")
        .where("value is not null")
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def describe_numeric(
    df: DataFrame, columns: list[str] | None = None, shares: tuple[float, ...] = (0.25, 0.5, 0.75), digits: int = 4
) -> DataFrame:
    """count, mean, std (n-1), min, quantiles, max; one row per numeric column."""
    cols = columns or numeric_columns(df)
    return _with_quantiles(_basics(df, cols), df, cols, shares, digits)


def _basics(df: DataFrame, cols: list[str]) -> DataFrame:
    wide = df.agg(
        *[
            f(F.col(c).cast("double")).alias(f"{p}_{i}")
            for i, c in enumerate(cols)
            for p, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_samp), ("lo", F.min), ("hi", F.max))
        ]
    )
    return _per_column(wide, cols, {"count": "n", "mean": "m", "std": "s", "min": "lo", "max": "hi"})


def _with_quantiles(basics, df, cols, shares, digits):
    q = exact_quantiles(df, cols, list(shares))
    wide = q.groupBy("column_name").agg(
        *[F.max(F.when(F.col("share") == s, F.col("q"))).alias(f"q{round(s * 100):02d}") for s in shares]
    )
    names = [f"q{round(s * 100):02d}" for s in shares]
    joined = basics.join(wide, "column_name", "left")
    return joined.select(
        "column_name", "count", *[F.round(c, digits).alias(c) for c in ["mean", "std", "min", *names, "max"]]
    )


def describe_group_sizes(df: DataFrame, group: str, positive: Column) -> DataFrame:
    """Distribution of rows and positives per group at 10, 50 and 90 percent."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("candidates"), F.count_if(positive).alias("positives"))
    return describe_numeric(sizes, ["candidates", "positives"], (0.1, 0.5, 0.9))


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = 10) -> DataFrame:
    freq = value_frequencies(df, columns or other_columns(df))
    return top_k(freq, k, [F.desc("n"), F.asc("value")], ["column_name"], "position")


def text_lengths(df: DataFrame, columns: list[str]) -> DataFrame:
    lengths = df.select(*[F.length(c).alias(c) for c in columns])
    return describe_numeric(lengths, columns)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows; nulls compare equal."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.sum("_n").alias("rows"), F.sum(F.col("_n") - 1).alias("duplicates")).select(
        "rows", "duplicates", F.round(F.try_divide(F.col("duplicates") * 100.0, F.col("rows")), 6).alias("pct_duplicates")
    )


def empty_columns(df: DataFrame) -> DataFrame:
    wide = df.agg(*[F.count(c).alias(f"n_{i}") for i, c in enumerate(df.columns)])
    return _per_column(wide, df.columns, {"n_values": "n"}).where("n_values = 0").select("column_name")


def rows_with_nulls(df: DataFrame, order: list[str], n: int = 20) -> DataFrame:
    return df.where(any_of([F.col(c).isNull() for c in df.columns])).orderBy(*order).limit(n)


def first_and_last(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    head = df.orderBy(F.asc(key)).limit(n).withColumn("part", F.lit("head"))
    tail = df.orderBy(F.desc(key)).limit(n).withColumn("part", F.lit("tail"))
    return head.unionByName(tail)


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def table_profiles(tables: dict[str, DataFrame]) -> DataFrame:
    """Column profile of several tables: type, nulls and distinct values.

    Rows and nulls are one aggregate per table; distinct values of all tables
    are one more scan of each and one shuffle. Types join on names, never on
    position.
    """
    facts, kinds = None, []
    for name, df in tables.items():
        numeric = set(numeric_columns(df))
        kinds += [(name, c, i, t, "numeric" if c in numeric else "categorical") for i, (c, t) in enumerate(df.dtypes)]
        wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n_{i}") for i, c in enumerate(df.columns)], F.count(F.lit(1)).alias("rows"))
        wide = wide.withColumns({f"r_{i}": F.col("rows") for i in range(len(df.columns))})
        part = _per_column(wide, df.columns, {"rows": "r", "n_missing": "n"}).withColumn("table_name", F.lit(name))
        facts = part if facts is None else facts.unionByName(part)
    facts = facts.join(_distinct_counts(tables), ["table_name", "column_name"])
    schema = "table_name string, column_name string, position int, dtype string, kind string"
    types = literal_rows(next(iter(tables.values())).sparkSession, kinds, schema)
    return types.join(facts, ["table_name", "column_name"]).select(
        "table_name",
        "column_name",
        "position",
        "dtype",
        "kind",
        "rows",
        "n_missing",
        F.round(F.try_divide(F.col("n_missing") * 100.0, F.col("rows")), 6).alias("pct_missing"),
        "n_unique",
    )


def schema_match(columns: DataFrame, required: DataFrame, aliases: DataFrame) -> DataFrame:
    """Match required fields to columns: exact name, then a known alias, else missing.

    ``columns(table_name, column_name)``, ``required(required_field)``,
    ``aliases(required_field, alias)``.
    """
    exact = required.join(columns, required["required_field"] == columns["column_name"]).select(
        "required_field", "table_name", "column_name", F.lit(0).alias("quality")
    )
    named = aliases.join(columns, aliases["alias"] == columns["column_name"]).select(
        "required_field", "table_name", "column_name", F.lit(1).alias("quality")
    )
    best = (
        exact.unionByName(named)
        .groupBy("required_field")
        .agg(F.min(F.struct("table_name", "quality", "column_name")).alias("m"))
    )
    kinds = F.when(F.col("m").isNull(), "Missing").when(F.col("m.quality") == 0, "Exact Match").otherwise("Safe Semantic Match")
    return required.join(best, "required_field", "left").select(
        "required_field",
        F.coalesce("m.table_name", F.lit("—")).alias("source_table"),
        F.coalesce("m.column_name", F.lit("—")).alias("actual_field"),
        kinds.alias("match_type"),
    )


def iqr_report(df: DataFrame, columns: list[str], factor: float = 1.5, digits: int = 4) -> DataFrame:
    """Spread, fences, values outside the fences and rows left, per column.

    The fences are two numbers per column; one aggregate counts what lies beyond them.
    """
    basics = _basics(df, columns)
    found = quantile_values(df, columns, [0.25, 0.5, 0.75])
    rows, counts = [], []
    for i, c in enumerate(columns):
        low, mid, high = (found.get((c, s)) for s in (0.25, 0.5, 0.75))
        lower, upper = (None, None) if low is None else (low - factor * (high - low), high + factor * (high - low))
        rows.append((c, low, mid, high, None if low is None else high - low, lower, upper))
        v = F.col(c).cast("double")
        counts.append(F.count_if((v < F.lit(lower)) | (v > F.lit(upper))).alias(f"o_{i}"))
    names = ["q25", "q50", "q75", "iqr", "lower", "upper"]
    fences = literal_rows(df.sparkSession, rows, "column_name string, " + ", ".join(f"{n} double" for n in names))
    outside = _per_column(df.agg(*counts), columns, {"outliers": "o"})
    fences = basics.join(F.broadcast(fences), "column_name")
    joined = fences.join(outside, "column_name")
    return joined.select(
        "column_name",
        "count",
        *[F.round(c, digits).alias(c) for c in ["mean", "std", "min", "q25", "q50", "q75", "max", "iqr", "lower", "upper"]],
        "outliers",
        F.round(F.try_divide(F.col("outliers"), F.col("count")), 6).alias("outlier_ratio"),
        (F.col("count") - F.col("outliers")).alias("rows_kept"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = singleton(df, F.count(F.lit(1)))
    return counts.select("value", "n", F.round(F.col("n") * 100.0 / total, 6).alias("pct"))


def class_distribution(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def group_summary(df: DataFrame, key: str, value: str, digits: int = 2) -> DataFrame:
    """Count, mean and sum of a value per key; a null key is a group."""
    return df.groupBy(key).agg(
        F.count(value).alias("n"),
        F.round(F.avg(value), digits).alias("mean_value"),
        F.round(F.sum(value), digits).alias("sum_value"),
    ).orderBy(F.desc("sum_value"), key)


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins over the observed range; the last bin is closed."""
    v = F.col(column).cast("double")
    low, high = singleton(df, F.min(v)), singleton(df, F.max(v))
    place = F.when(high > low, F.least(F.floor((v - low) / (high - low) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    counts = df.where(v.isNotNull()).groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    step = (high - low) / bins
    return counts.select(
        "bin",
        F.round(low + F.col("bin") * step, 4).alias("low"),
        F.round(low + (F.col("bin") + 1) * step, 4).alias("high"),
        "n",
    )


def box_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    return iqr_report(df, columns).select("column_name", "min", "lower", "q25", "q50", "q75", "upper", "max", "outliers")


def split_audit(df: DataFrame, split: str, group: str, item: str, label: str) -> DataFrame:
    """Rows, positive rate and unique groups per split, with the overlaps."""
    per_split = df.groupBy(split).agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(F.col(label).cast("double")), 6).alias("positive_rate"))
    out = per_split
    for name, key in (("group", group), ("item", item)):
        seen = df.select(key, split).distinct()
        members = seen.groupBy(key).agg(F.collect_set(split).alias("splits"))  # at most one entry per split
        facts = members.select(F.explode("splits").alias(split), flag(F.size("splits") > 1).alias("shared"))
        out = out.join(
            facts.groupBy(split).agg(F.count(F.lit(1)).alias(f"unique_{name}s"), F.sum("shared").alias(f"shared_{name}s")), split
        )
    return out

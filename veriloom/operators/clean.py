"""Cleaning, imputation, derived columns and row rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import any_of, as_column, band, flag, is_true, literal_rows, ratio, to_number
from .ordered import join_groups, keep_first, quantile_values

# Cut points, band names and action texts that users see.
BAND_CUTS_SERVICE = [0.4, 0.7]
BAND_CUTS_APP = [0.35, 0.65]
BANDS = ["Düşük", "Orta", "Yüksek"]
ACTIONS = {
    "Düşük": "Standart müşteri deneyimini sürdürün, memnuniyet sinyallerini periyodik olarak takip edin.",
    "Orta": "Memnuniyet görüşmesi planlayın, kullanım davranışlarını inceleyin ve kişiselleştirilmiş teklif değerlendirin.",
    "Yüksek": "Müşteriyi öncelikli retention listesine alın; özel teklif, sözleşme yenileme avantajı veya doğrudan destek görüşmesi planlayın.",
}
SIGNAL_MONTHLY_CONTRACT = "Aylık sözleşme kullanıyor; uzun vadeli bağlılık düşük olabilir."
SIGNAL_SHORT_TENURE = "Müşterilik süresi 12 aydan kısa."
SIGNAL_HIGH_CHARGE = "Aylık ücret seviyesi yüksek."
SIGNAL_NO_SUPPORT = "Teknik destek hizmeti bulunmuyor."
SIGNAL_NO_SECURITY = "Çevrimiçi güvenlik hizmeti bulunmuyor."
SIGNAL_CHECK = "Ödeme yöntemi elektronik çek."
SIGNAL_FIBER = "Fiber internet müşterilerinde fiyat ve beklenti hassasiyeti görülebilir."
SIGNAL_PAPERLESS = "Kağıtsız faturalandırma kullanıyor."
SIGNAL_NONE = "Belirgin bir yüksek risk sinyali tespit edilmedi."


def coerce_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: to_number(c) for c in columns})


def impute_median(df: DataFrame, columns: list[str], fit: DataFrame | None = None) -> DataFrame:
    """Nulls become the exact median of the fit set (default: the table itself)."""
    medians = quantile_values(df if fit is None else fit, columns, [0.5])
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(medians.get((c, 0.5)))) for c in columns})


def most_frequent(fit: DataFrame, column: str) -> Column:
    """Most frequent non-null value, smallest first on ties, as a scalar subquery."""
    counts = fit.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(column).alias("v")))["v"]).scalar()


def impute_mode(df: DataFrame, columns: list[str], fit: DataFrame | None = None) -> DataFrame:
    source = df if fit is None else fit
    return df.withColumns({c: F.coalesce(F.col(c), most_frequent(source, c)) for c in columns})


def date_parts(df: DataFrame, column: str, fmt: str | None = None) -> DataFrame:
    """Parsed day with year, month, day and weekday name; bad text is null."""
    text = F.col(column).cast("string")
    ts = F.try_to_timestamp(text, F.lit(fmt)) if fmt else F.try_to_timestamp(text)
    return df.withColumns(
        {
            f"{column}_year": F.year(ts),
            f"{column}_month": F.month(ts),
            f"{column}_day": F.day(ts),
            f"{column}_weekday": F.date_format(ts, "EEEE"),
        }
    )


def drop_repeats(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return keep_first(df, keys, order)


def flag_repeated_keys(df: DataFrame, keys: list[str], name: str = "is_duplicate") -> DataFrame:
    """True on every row whose key occurs more than once."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    return join_groups(df, sizes, keys, "_size").withColumn(name, F.col("_size") > 1).drop("_size")


def keep_valid(df: DataFrame, invalid: list[Column]) -> DataFrame:
    """Rows that break no rule; a null never breaks one."""
    return df.where(~is_true(any_of(invalid)))


def cleaning_audit(df: DataFrame, invalid: list[Column]) -> DataFrame:
    """Input rows, repeats, invalid rows after deduplication, output rows."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_bad", is_true(any_of(invalid)))
    return groups.agg(
        F.sum("_n").alias("input_rows"),
        F.sum(F.col("_n") - 1).alias("duplicate_rows"),
        F.count_if("_bad").alias("invalid_rows_removed"),
        F.count_if(~F.col("_bad")).alias("output_rows"),
    )


def with_ratios(df: DataFrame, ratios: dict[str, tuple[str, str]]) -> DataFrame:
    return df.withColumns({name: ratio(a, b) for name, (a, b) in ratios.items()})


def customer_features(
    df: DataFrame,
    tenure: str,
    monthly: str,
    total: str,
    support: Column,
    high_charge: float = 70.0,
    long_term: int = 24,
) -> DataFrame:
    """Average spend, long-term, support and high-charge flags.

    The average falls back to the monthly charge when tenure is zero or the
    quotient is null; training and batch scoring share this one form.
    """
    return df.withColumns(
        {
            "avg_monthly_spend": F.coalesce(ratio(total, tenure), F.col(monthly)),
            "is_long_term": flag(F.col(tenure) >= long_term),
            "has_support": flag(support),
            "high_monthly_charge": flag(F.col(monthly) > high_charge),
        }
    )


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*[c for c in columns if c in df.columns])


def risk_band(probability: str | Column, cuts: list[float] = BAND_CUTS_SERVICE) -> Column:
    return band(probability, cuts, BANDS)


def with_action(df: DataFrame, band_column: str = "risk_band") -> DataFrame:
    """Recommended action per band, from a three-row lookup."""
    lookup = literal_rows(df.sparkSession, list(ACTIONS.items()), f"{band_column} string, action string")
    return df.join(F.broadcast(lookup), band_column, "left")


def risk_signals(
    contract: Column,
    tenure: Column,
    monthly: Column,
    support: Column,
    security: Column,
    payment: Column,
    internet: Column,
    paperless: Column,
) -> Column:
    """Texts of the rules a customer meets, in rule order; a default when none."""
    missing = ["No", "No internet service"]
    rules = [
        (contract == "Month-to-month", SIGNAL_MONTHLY_CONTRACT),
        (tenure < 12, SIGNAL_SHORT_TENURE),
        (monthly > 70, SIGNAL_HIGH_CHARGE),
        (support.isin(missing), SIGNAL_NO_SUPPORT),
        (security.isin(missing), SIGNAL_NO_SECURITY),
        (payment == "Electronic check", SIGNAL_CHECK),
        (internet == "Fiber optic", SIGNAL_FIBER),
        (paperless == "Yes", SIGNAL_PAPERLESS),
    ]
    found = F.array_compact(F.array(*[F.when(is_true(c), F.lit(text)) for c, text in rules]))
    return F.when(F.size(found) == 0, F.array(F.lit(SIGNAL_NONE))).otherwise(found)


def pivot_metric(df: DataFrame, keys: list[str], method: str, value: str, methods: list[str]) -> DataFrame:
    return df.groupBy(*keys).pivot(method, methods).agg(F.first(value))


def pivot_delta(df: DataFrame, keys: list[str], method: str, value: str, new: str, base: str, name: str = "delta") -> DataFrame:
    wide = pivot_metric(df, keys, method, value, [base, new])
    return wide.withColumn(name, as_column(new) - as_column(base))


def unpivot(df: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(keys, columns, name, value)

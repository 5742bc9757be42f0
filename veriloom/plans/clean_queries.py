"""Cleaning, derivation and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import interval, recode, title_case
from ..operators import clean as C
from ..operators import sampling as S
from . import roles
from .registry import query


@query(
    "C1_numeric_coercion",
    f"WITH {roles.CUSTOMER_TEXT} SELECT c_custkey, TRY_CAST(trim(replace(c_acctbal, ',', '.')) AS DOUBLE) AS c_acctbal FROM customer_text",
)
def _(t):
    return C.coerce_numbers(roles.customer_text(t), ["c_acctbal"]).select("c_custkey", "c_acctbal")


@query(
    "C2_median_imputation",
    f"""WITH {roles.ORDERS_NULLED} SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT median(o_totalprice) FROM orders_nulled)), 4) AS o_totalprice
    FROM orders_nulled""",
)
def _(t):
    out = C.impute_median(roles.orders_nulled(t), ["o_totalprice"])
    return out.select("o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"))


@query(
    "C3_mode_imputation",
    f"""WITH {roles.ORDERS_NULLED}, m AS (SELECT o_orderstatus FROM orders_nulled WHERE o_orderstatus IS NOT NULL
      GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT o_orderkey, coalesce(o_orderstatus, (SELECT o_orderstatus FROM m)) AS o_orderstatus FROM orders_nulled""",
)
def _(t):
    return C.impute_mode(roles.orders_nulled(t), ["o_orderstatus"]).select("o_orderkey", "o_orderstatus")


@query(
    "C4_date_parts",
    """WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'not a date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders),
    p AS (SELECT o_orderkey, TRY_CAST(day AS DATE) AS d FROM d)
    SELECT o_orderkey, CAST(year(d) AS INTEGER) AS day_year, CAST(month(d) AS INTEGER) AS day_month, CAST(day(d) AS INTEGER) AS day_day, dayname(d) AS day_weekday FROM p""",
)
def _(t):
    text = F.when(F.col("o_orderkey") % 13 == 0, "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return C.date_parts(t.orders.select("o_orderkey", text.alias("day")), "day").drop("day")


@query("C5_full_row_dedupe", f"WITH {roles.ORDERS_REPEATED} SELECT DISTINCT * FROM orders_repeated")
def _(t):
    return C.drop_repeats(roles.orders_repeated(t))


@query(
    "C6_keyed_keep_first",
    f"""WITH {roles.EVENTS_REPEATED} SELECT user_id, event_type, event_id, copy FROM events_repeated
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id, copy) = 1""",
)
def _(t):
    out = C.first_per_key(roles.events_repeated(t), ["user_id", "event_type"], ["event_id", "copy"])
    return out.select("user_id", "event_type", "event_id", "copy")


@query(
    "C7_duplicate_pair_flag",
    f"""WITH {roles.EVENTS_REPEATED} SELECT user_id, event_id, copy, count(*) OVER (PARTITION BY user_id, event_id) > 1 AS is_duplicate
    FROM events_repeated""",
)
def _(t):
    out = C.flag_repeated_keys(roles.events_repeated(t), ["user_id", "event_id"])
    return out.select("user_id", "event_id", "copy", "is_duplicate")


@query(
    "C8_title_case",
    r"""WITH n AS (SELECT p_partkey, regexp_replace(trim('  ' || p_name || '  x-' || lower(p_type) || ' '), '\s+', ' ', 'g') AS s FROM part)
    SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(s, '([a-zA-Z]+|[^a-zA-Z]+)'),
       lambda w: upper(w[1:1]) || lower(w[2:])), '') AS name FROM n""",
)
def _(t):
    raw = F.concat(F.lit("  "), "p_name", F.lit("  x-"), F.lower("p_type"), F.lit(" "))
    return t.part.select("p_partkey", title_case(raw).alias("name"))


_INVALID_SQL = "unit_price <= 0 OR amount <= 0 OR delivery_days < 0 OR rating > 5"


def _invalid():
    return [F.col("unit_price") <= 0, F.col("amount") <= 0, F.col("delivery_days") < 0, F.col("rating") > 5]


@query(
    "C9_valid_rows",
    f"""WITH {roles.TRANSACTIONS} SELECT l_orderkey, l_linenumber, city, delivery_days, rating FROM transactions
    WHERE NOT coalesce({_INVALID_SQL}, false)""",
)
def _(t):
    out = C.keep_valid(roles.transactions(t), _invalid())
    return out.select("l_orderkey", "l_linenumber", "city", "delivery_days", "rating")


@query(
    "C10_cleaning_audit",
    f"""WITH {roles.TRANSACTIONS}, twice AS (SELECT * FROM transactions UNION ALL SELECT * FROM transactions WHERE l_orderkey % 50 = 0),
    d AS (SELECT DISTINCT * FROM twice)
    SELECT (SELECT count(*) FROM twice) AS input_rows, (SELECT count(*) FROM twice) - count(*) AS duplicate_rows,
           count(*) FILTER (coalesce({_INVALID_SQL}, false)) AS invalid_rows_removed,
           count(*) FILTER (NOT coalesce({_INVALID_SQL}, false)) AS output_rows FROM d""",
)
def _(t):
    base = roles.transactions(t)
    return C.cleaning_audit(base.unionByName(base.where(F.col("l_orderkey") % 50 == 0)), _invalid())


@query(
    "C11_safe_ratios",
    """SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_quantity, 0) AS price_per_unit,
       l_tax / nullif(l_discount, 0) AS tax_per_discount FROM lineitem""",
)
def _(t):
    out = C.with_ratios(
        t.lineitem, {"price_per_unit": ("l_extendedprice", "l_quantity"), "tax_per_discount": ("l_tax", "l_discount")}
    )
    return out.select(
        "l_orderkey", "l_linenumber", "price_per_unit", "tax_per_discount"
    )


@query(
    "C12_customer_features",
    f"""WITH {roles.CUSTOMER_ROLE} SELECT c_custkey, tenure, coalesce(total / nullif(tenure, 0), monthly) AS avg_monthly_spend,
       CASE WHEN tenure >= 24 THEN 1 ELSE 0 END AS is_long_term, CASE WHEN contract IN ('BUILDING', 'MACHINERY') THEN 1 ELSE 0 END AS has_support,
       CASE WHEN monthly > 70 THEN 1 ELSE 0 END AS high_monthly_charge FROM customer_role""",
)
def _(t):
    support = F.col("contract").isin("BUILDING", "MACHINERY")
    out = C.customer_features(roles.customer_role(t), "tenure", "monthly", "total", support)
    return out.select(
        "c_custkey", "tenure", "avg_monthly_spend", "is_long_term", "has_support", "high_monthly_charge"
    )


@query("C13_drop_columns", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def _(t):
    return C.drop_columns(t.customer, ["c_name", "c_nationkey", "c_reason"])


@query(
    "C14_risk_bands",
    f"""WITH {roles.SCORED} SELECT event_id, CASE WHEN p < 0.4 THEN 'Düşük' WHEN p < 0.7 THEN 'Orta' ELSE 'Yüksek' END AS band_service,
       CASE WHEN p < 0.35 THEN 'Düşük' WHEN p < 0.65 THEN 'Orta' ELSE 'Yüksek' END AS band_app FROM scored""",
)
def _(t):
    return roles.scored(t).select(
        "event_id", C.risk_band("p").alias("band_service"), C.risk_band("p", C.BAND_CUTS_APP).alias("band_app")
    )


@query(
    "C15_recommended_action",
    f"""WITH {roles.SCORED}, b AS (SELECT event_id, CASE WHEN p < 0.35 THEN 'Düşük' WHEN p < 0.65 THEN 'Orta' ELSE 'Yüksek' END AS risk_band FROM scored)
    SELECT event_id, risk_band, CASE risk_band {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in C.ACTIONS.items())} END AS action FROM b""",
)
def _(t):
    banded = roles.scored(t).select("event_id", C.risk_band("p", C.BAND_CUTS_APP).alias("risk_band"))
    return C.with_action(banded)


_SIGNAL_CASES = ", ".join(
    f"CASE WHEN {cond} THEN '{text}' END"
    for cond, text in [
        ("contract = 'BUILDING'", C.SIGNAL_MONTHLY_CONTRACT),
        ("tenure < 12", C.SIGNAL_SHORT_TENURE),
        ("monthly > 70", C.SIGNAL_HIGH_CHARGE),
        ("contract = 'MACHINERY'", C.SIGNAL_NO_SUPPORT),
        ("c_nationkey % 2 = 0", C.SIGNAL_NO_SECURITY),
        ("c_nationkey % 3 = 0", C.SIGNAL_CHECK),
        ("contract = 'FURNITURE'", C.SIGNAL_FIBER),
        ("c_nationkey % 5 = 0", C.SIGNAL_PAPERLESS),
    ]
)


@query(
    "C16_risk_signals",
    f"""WITH {roles.CUSTOMER_ROLE}, s AS (SELECT c_custkey, list_filter([{_SIGNAL_CASES}], lambda x: x IS NOT NULL) AS f FROM customer_role)
    SELECT c_custkey, CASE WHEN len(f) = 0 THEN '{C.SIGNAL_NONE}' ELSE array_to_string(f, ' | ') END AS signals FROM s""",
)
def _(t):
    def yes(cond, a="Yes", b=""):
        return F.when(cond, F.lit(a)).otherwise(F.lit(b))

    signals = C.risk_signals(
        contract=yes(F.col("contract") == "BUILDING", "Month-to-month"),
        tenure=F.col("tenure"),
        monthly=F.col("monthly"),
        support=yes(F.col("contract") == "MACHINERY", "No", "Yes"),
        security=yes(F.col("c_nationkey") % 2 == 0, "No internet service", "Yes"),
        payment=yes(F.col("c_nationkey") % 3 == 0, "Electronic check"),
        internet=yes(F.col("contract") == "FURNITURE", "Fiber optic"),
        paperless=yes(F.col("c_nationkey") % 5 == 0),
    )
    return roles.customer_role(t).select("c_custkey", F.array_join(signals, " | ").alias("signals"))


@query(
    "C17_label_mapping",
    f"WITH {roles.SCORED} SELECT event_id, CASE WHEN prediction = 1 THEN 'positive' ELSE 'negative' END AS sentiment FROM scored",
)
def _(t):
    return roles.scored(t).select("event_id", recode("prediction", {1: "positive", 0: "negative"}).alias("sentiment"))


@query(
    "C18_right_closed_buckets",
    f"""WITH {roles.SCORED} SELECT event_id, CASE WHEN p > -0.01 AND p <= 0 THEN '(-0.01, 0.0]' WHEN p > 0 AND p <= 0.2 THEN '(0.0, 0.2]'
      WHEN p > 0.2 AND p <= 0.5 THEN '(0.2, 0.5]' WHEN p > 0.5 AND p <= 1 THEN '(0.5, 1.0]' END AS bucket FROM scored""",
)
def _(t):
    labels = ["(-0.01, 0.0]", "(0.0, 0.2]", "(0.2, 0.5]", "(0.5, 1.0]"]
    return roles.scored(t).select("event_id", interval("p", [-0.01, 0.0, 0.2, 0.5, 1.0], labels).alias("bucket"))


# --- samples and splits -------------------------------------------------------------


@query(
    "P1_row_sample",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
    ORDER BY md5('42|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_extendedprice), l_orderkey, l_linenumber, l_partkey, l_extendedprice LIMIT 5000""",
)
def _(t):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    return S.sample_rows(t.lineitem.select(*keys), keys, 5000).select(*keys[:3])


@query(
    "P2_group_sample_to_rows",
    """WITH g AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1),
    c AS (SELECT user_id, n, sum(n) OVER (ORDER BY md5('42|' || user_id), user_id ROWS UNBOUNDED PRECEDING) AS upto FROM g)
    SELECT user_id, event_id FROM events WHERE user_id IN (SELECT user_id FROM c WHERE upto - n < 3000)""",
)
def _(t):
    return S.sample_groups_to_rows(t.events.select("user_id", "event_id"), "user_id", 3000)


@query(
    "P3_first_groups",
    """WITH g AS (SELECT user_id FROM events GROUP BY 1 HAVING max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) = 1
      ORDER BY md5('42|' || user_id), user_id LIMIT 100)
    SELECT user_id, event_id FROM events WHERE user_id IN (SELECT user_id FROM g)""",
)
def _(t):
    out = S.sample_groups(t.events, "user_id", 100, 42, F.col("event_type") == "purchase")
    return out.select("user_id", "event_id")


@query(
    "P3_group_sample_audit",
    f"""WITH {roles.EVENTS_REPEATED}, a AS (SELECT user_id, max(CASE WHEN event_type = 'purchase' AND value > 100 THEN 1 ELSE 0 END) AS ok FROM events_repeated GROUP BY 1),
    g AS (SELECT user_id FROM a WHERE ok = 1 ORDER BY md5('42|' || user_id), user_id LIMIT 100),
    p AS (SELECT user_id, event_id, count(*) AS n, count(*) FILTER (event_type = 'purchase' AND value > 100) AS pos FROM events_repeated WHERE user_id IN (SELECT user_id FROM g) GROUP BY ALL)
    SELECT count(DISTINCT user_id) AS "groups", CAST(sum(n) AS BIGINT) AS "rows", CAST(sum(n - 1) AS BIGINT) AS repeated_pairs,
           CAST(sum(pos) AS BIGINT) AS positives, (SELECT count(*) FROM a WHERE ok = 0) AS groups_without_positive FROM p""",
)
def _(t):
    positive = (F.col("event_type") == "purchase") & (F.col("value") > 100)
    return S.group_sample_audit(roles.events_repeated(t), "user_id", "event_id", positive, 100)


def _ranked(keys: str, source: str, seed: str = "42") -> str:
    return f"k AS (SELECT {keys}, row_number() OVER (ORDER BY md5('{seed}|' || {keys}), {keys}) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT {keys} FROM {source}))"


_SPLIT_CASE = "CASE WHEN r <= floor(0.7::DOUBLE * n) THEN 'train' WHEN r <= floor(0.85::DOUBLE * n) THEN 'validation' ELSE 'test' END"


@query(
    "P4_group_split",
    f"WITH {_ranked('conv_id', 'conversations')} SELECT conv_id, turn, {_SPLIT_CASE} AS split FROM conversations JOIN k USING (conv_id)",
)
def _(t):
    return S.split_groups(t.conversations.select("conv_id", "turn"), "conv_id")


@query(
    "P4_group_split_events",
    f"WITH {_ranked('user_id', 'events')} SELECT event_id, {_SPLIT_CASE} AS split FROM events JOIN k USING (user_id)",
)
def _(t):
    return S.split_groups(t.events.select("user_id", "event_id"), "user_id").select("event_id", "split")


@query(
    "P5_group_holdout",
    f"""WITH {_ranked('l_orderkey', 'lineitem')} SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN r <= ceil(0.2::DOUBLE * n) THEN 'test' ELSE 'train' END AS split
    FROM lineitem JOIN k USING (l_orderkey)""",
)
def _(t):
    return S.holdout_groups(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey")


@query(
    "P5_item_holdout",
    f"""WITH {_ranked('l_partkey', 'lineitem')} SELECT split, count(*) AS n FROM (SELECT CASE WHEN r <= ceil(0.2::DOUBLE * n) THEN 'test' ELSE 'train' END AS split
    FROM lineitem JOIN k USING (l_partkey)) GROUP BY split""",
)
def _(t):
    return S.holdout_groups(t.lineitem.select("l_partkey"), "l_partkey").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "P6_stratified_split",
    """WITH k AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels)
    SELECT doc_id, quality, CASE WHEN r <= floor(0.6::DOUBLE * n) THEN 'train' WHEN r <= floor(0.8::DOUBLE * n) THEN 'validation' ELSE 'test' END AS split FROM k""",
)
def _(t):
    labels = t.labels.select("doc_id", "quality")
    return S.split_rows(labels, ["doc_id"], (0.6, 0.8), ("train", "validation", "test"), strata=["quality"])


@query(
    "P6_stratified_holdout",
    """WITH k AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels)
    SELECT doc_id, quality, CASE WHEN r <= floor(0.8::DOUBLE * n) THEN 'train' ELSE 'test' END AS split FROM k""",
)
def _(t):
    return S.split_rows(t.labels.select("doc_id", "quality"), ["doc_id"], (0.8,), ("train", "test"), strata=["quality"])


@query(
    "P6_plain_split",
    """WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) AS r, count(*) OVER () AS n FROM orders)
    SELECT o_orderkey, CASE WHEN r <= floor(0.6::DOUBLE * n) THEN 'train' WHEN r <= floor(0.8::DOUBLE * n) THEN 'validation' ELSE 'test' END AS split FROM k""",
)
def _(t):
    return S.split_rows(t.orders.select("o_orderkey"), ["o_orderkey"], (0.6, 0.8), ("train", "validation", "test"))


@query(
    "P7_stratified_folds",
    "SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || doc_id), doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels",
)
def _(t):
    return S.row_folds(t.labels.select("doc_id", "quality"), ["doc_id"], 5, strata=["quality"])


@query(
    "P7_plain_folds",
    "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders",
)
def _(t):
    return S.row_folds(t.orders.select("o_orderkey"), ["o_orderkey"], 5)


@query(
    "P7_group_folds",
    f"WITH {_ranked('user_id', 'events')} SELECT event_id, CAST((r - 1) % 3 AS INTEGER) AS fold FROM events JOIN k USING (user_id)",
)
def _(t):
    return S.group_folds(t.events.select("user_id", "event_id"), "user_id", 3).select("event_id", "fold")


@query(
    "P8_stride_sample",
    f"""WITH {roles.JUDGMENTS}, k AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS r FROM documents)
    SELECT doc_id, CASE WHEN doc_id IN (SELECT item_id FROM judgments) THEN 'required' ELSE 'stride' END AS origin FROM k
    WHERE (r - 1) % 19 = 0 OR doc_id IN (SELECT item_id FROM judgments)""",
)
def _(t):
    return S.stride_sample(t.documents.select("doc_id"), "doc_id", roles.judgments(t).select("item_id"))


@query(
    "P9_repeated_seed_splits",
    f"""WITH s AS (SELECT unnest([42, 52, 62, 72, 82]) AS seed), u AS (SELECT DISTINCT user_id FROM events),
    k AS (SELECT seed, user_id, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || '|' || user_id), user_id) AS r, count(*) OVER (PARTITION BY seed) AS n FROM s, u)
    SELECT seed, user_id, {_SPLIT_CASE} AS split FROM k""",
)
def _(t):
    return S.split_groups_by_seed(t.events, "user_id", [42, 52, 62, 72, 82])


@query(
    "P10_hard_negative_variants",
    f"""WITH {roles.SCORED}, h AS (SELECT event_id, 1 + (event_id % 2) * 0.5::DOUBLE AS weight, label = 0 AND p >= 0.5 AS hard FROM scored)
    SELECT 'original' AS variant, event_id, weight FROM h UNION ALL SELECT 'weighted', event_id, weight * CASE WHEN hard THEN 2 ELSE 1 END FROM h
    UNION ALL SELECT 'enriched', event_id, weight FROM h UNION ALL SELECT 'enriched', event_id, weight FROM h WHERE hard
    UNION ALL SELECT 'weighted_enriched', event_id, weight * CASE WHEN hard THEN 2 ELSE 1 END FROM h
    UNION ALL SELECT 'weighted_enriched', event_id, weight * 2 FROM h WHERE hard""",
)
def _(t):
    rows = roles.scored(t).select(
        "event_id", (1 + (F.col("event_id") % 2) * 0.5).alias("weight"), ((F.col("label") == 0) & (F.col("p") >= 0.5)).alias("hard")
    )
    return S.hard_negative_variants(rows, "hard", "weight").select("variant", "event_id", "weight")

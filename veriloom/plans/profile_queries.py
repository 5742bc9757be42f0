"""Profiles and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import literal_rows
from ..operators import profile as P
from ..operators import sampling
from ..sources import files
from . import roles
from .registry import query
from .source_queries import TABLE_NAMES


def _stack(table: str, columns: list[str], body: str) -> str:
    return " UNION ALL ".join(body.format(c=c, table=table) for c in columns)


_NULLED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_comment"]
_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "Q1_missing_counts",
    f"WITH {roles.ORDERS_NULLED} "
    + _stack(
        "orders_nulled",
        _NULLED,
        "SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS n_missing, "
        "round(count(*) FILTER ({c} IS NULL) * 100.0::DOUBLE / count(*), 6) AS pct_missing FROM {table}",
    ),
)
def _(t):
    return P.missing_counts(roles.orders_nulled(t))


# The columns of the test tables with Spark's type names.
TYPES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def _columns_of(table: str):
    for i, entry in enumerate(TYPES[table].split(", ")):
        column, kind = entry.split(" ")
        yield i, column, kind, "numeric" if kind in P.NUMERIC_TYPES else "categorical"


_TYPE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {i} AS position, '{k}' AS dtype, '{g}' AS kind, count({c}) AS n_values FROM lineitem" for i, c, k, g in _columns_of("lineitem")
)
_PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, {i} AS position, '{k}' AS dtype, '{g}' AS kind, count(*) AS \"rows\", count(*) - count({c}) AS n_missing, "
    f"round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6) AS pct_missing, count(DISTINCT {c}) AS n_unique FROM {t}"
    for t in TYPES
    for i, c, k, g in _columns_of(t)
)


@query("Q2_type_summary", _TYPE_SQL)
def _(t):
    return P.type_summary(t.lineitem)


@query(
    "Q3_cardinality",
    _stack("customer", _CUSTOMER, "SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_unique FROM {table}"),
)
def _(t):
    return P.cardinality(t.customer)


def _describe_sql(table: str, columns: list[str], shares=(0.25, 0.5, 0.75)) -> str:
    qs = ", ".join(f"round(quantile_cont(CAST({{c}} AS DOUBLE), {s}), 4) AS q{round(s * 100):02d}" for s in shares)
    return _stack(
        table,
        columns,
        "SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
        "round(CAST(min({c}) AS DOUBLE), 4) AS min, " + qs + ", round(CAST(max({c}) AS DOUBLE), 4) AS max FROM {table}",
    )


@query("Q4_describe_numeric", _describe_sql("lineitem", _LINE))
def _(t):
    return P.describe_numeric(t.lineitem, _LINE)


@query("Q4_describe_by_brackets", _describe_sql("lineitem", ["l_extendedprice"]))
def _(t):
    """The path for columns with too many distinct values for one aggregate."""
    return P.describe_numeric(t.lineitem, ["l_extendedprice"])


@query(
    "Q5_group_size_distribution",
    "WITH g AS (SELECT user_id, count(*) AS candidates, count(*) FILTER (event_type = 'purchase') AS positives FROM events GROUP BY user_id) "
    + _describe_sql("g", ["candidates", "positives"], (0.1, 0.5, 0.9)),
)
def _(t):
    return P.describe_group_sizes(t.events, "user_id", F.col("event_type") == "purchase")


@query(
    "Q6_top_values",
    """WITH v AS (SELECT 'c_name' AS column_name, c_name AS value FROM customer UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer),
    n AS (SELECT column_name, value, count(*) AS n FROM v GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS position FROM n
    QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) <= 10""",
)
def _(t):
    return P.top_values(t.customer)


@query(
    "Q7_text_lengths",
    "WITH d AS (SELECT length(text) AS text, length(lang) AS lang FROM documents) " + _describe_sql("d", ["text", "lang"]),
)
def _(t):
    return P.text_lengths(t.documents, ["text", "lang"])


@query(
    "Q8_duplicate_rows",
    f"""WITH {roles.ORDERS_REPEATED}, g AS (SELECT count(*) AS n FROM orders_repeated GROUP BY o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority)
    SELECT CAST(sum(n) AS BIGINT) AS "rows", CAST(sum(n - 1) AS BIGINT) AS duplicates,
           round(sum(n - 1) * 100::DOUBLE / sum(n), 6) AS pct_duplicates FROM g""",
)
def _(t):
    return P.duplicate_rows(roles.orders_repeated(t))


@query(
    "Q9_empty_columns",
    f"WITH {roles.ORDERS_NULLED}, c AS ("
    + _stack("orders_nulled", _NULLED, "SELECT '{c}' AS column_name, count({c}) AS n FROM {table}")
    + ") SELECT column_name FROM c WHERE n = 0",
)
def _(t):
    return P.empty_columns(roles.orders_nulled(t))


@query(
    "Q10_rows_with_nulls",
    f"""WITH {roles.ORDERS_NULLED} SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders_nulled
    WHERE o_orderstatus IS NULL OR o_totalprice IS NULL OR o_orderpriority IS NULL ORDER BY o_orderkey LIMIT 20""",
)
def _(t):
    df = roles.orders_nulled(t).select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return P.rows_with_nulls(df, ["o_orderkey"])


@query(
    "Q11_first_and_last_rows",
    """(SELECT o_orderkey, o_totalprice, 'head' AS part FROM orders ORDER BY o_orderkey LIMIT 10)
    UNION ALL (SELECT o_orderkey, o_totalprice, 'tail' FROM orders ORDER BY o_orderkey DESC LIMIT 10)""",
)
def _(t):
    return P.first_and_last(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey")


@query("Q11_shape", 'SELECT count(*) AS "rows", 6 AS columns FROM orders')
def _(t):
    return P.shape(t.orders)


@query("Q12_table_profiles", _PROFILE_SQL)
def _(t):
    return P.table_profiles({n: getattr(t, n) for n in TABLE_NAMES})


_REQUIRED = ["order_date", "o_totalprice", "category", "c_name", "delivery_days"]
_ALIASES = [("category", "p_type"), ("order_date", "o_orderdate")]


@query(
    "Q13_schema_match",
    """SELECT * FROM (VALUES ('order_date', 'orders', 'o_orderdate', 'Safe Semantic Match'), ('o_totalprice', 'orders', 'o_totalprice', 'Exact Match'),
      ('category', 'part', 'p_type', 'Safe Semantic Match'), ('c_name', 'customer', 'c_name', 'Exact Match'),
      ('delivery_days', '—', '—', 'Missing')) v(required_field, source_table, actual_field, match_type)""",
)
def _(t):
    inventory = files.file_inventory(t.spark, {n: t.path(n) for n in TABLE_NAMES})
    columns = inventory.select("table_name", F.explode(F.split("columns", ",")).alias("column_name")).distinct()
    required = literal_rows(t.spark, [(r,) for r in _REQUIRED], "required_field string")
    aliases = literal_rows(t.spark, _ALIASES, "required_field string, alias string")
    return P.schema_match(columns, required, aliases)


def _iqr_sql(table: str, columns: list[str]) -> str:
    return _stack(
        table,
        columns,
        "SELECT '{c}' AS column_name, count, round(mean, 4) AS mean, round(std, 4) AS std, round(mn, 4) AS min, round(q1, 4) AS q25, "
        "round(q2, 4) AS q50, round(q3, 4) AS q75, round(mx, 4) AS max, round(q3 - q1, 4) AS iqr, "
        "round(q1 - CAST(1.5 AS DOUBLE) * (q3 - q1), 4) AS lower, round(q3 + CAST(1.5 AS DOUBLE) * (q3 - q1), 4) AS upper, outliers, "
        "round(CAST(outliers AS DOUBLE) / count, 6) AS outlier_ratio, count - outliers AS rows_kept FROM ("
        "SELECT count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, CAST(min({c}) AS DOUBLE) AS mn, CAST(max({c}) AS DOUBLE) AS mx, any_value(q1) AS q1, "
        "any_value(q2) AS q2, any_value(q3) AS q3, count(*) FILTER ({c} < q1 - CAST(1.5 AS DOUBLE) * (q3 - q1) OR {c} > q3 + CAST(1.5 AS DOUBLE) * (q3 - q1)) AS outliers "
        "FROM {table}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM {table}))",
    )


@query("Q14_iqr_outliers", _iqr_sql("lineitem", ["l_extendedprice", "l_quantity", "l_tax"]))
def _(t):
    return P.iqr_report(t.lineitem, ["l_extendedprice", "l_quantity", "l_tax"])


@query(
    "Q15_value_counts",
    "SELECT c_mktsegment AS value, count(*) AS n, round(count(*) * 100::DOUBLE / sum(count(*)) OVER (), 6) AS pct FROM customer GROUP BY 1",
)
def _(t):
    return P.value_counts(t.customer, "c_mktsegment")


@query(
    "Q16_class_distribution",
    "SELECT source, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL",
)
def _(t):
    return P.class_distribution(roles.review_texts(t), ["source", "quality"])


@query(
    "Q17_group_summary",
    """SELECT CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS c_mktsegment, count(o_totalprice) AS n,
      round(avg(o_totalprice), 2) AS mean_value, round(sum(o_totalprice), 2) AS sum_value
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
)
def _(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.select(F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("c_mktsegment"), "o_totalprice")
    return P.group_summary(joined, "c_mktsegment", "o_totalprice")


@query(
    "Q18_histogram",
    """WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
    b AS (SELECT CAST(least(floor((o_totalprice - lo) / (hi - lo) * 30), 29) AS INTEGER) AS bin, lo, hi FROM orders, r)
    SELECT bin, round(any_value(lo) + bin * ((any_value(hi) - any_value(lo)) / 30), 4) AS low,
           round(any_value(lo) + (bin + 1) * ((any_value(hi) - any_value(lo)) / 30), 4) AS high, count(*) AS n FROM b GROUP BY bin""",
)
def _(t):
    return P.histogram(t.orders, "o_totalprice")


@query(
    "Q18_box_statistics",
    'SELECT column_name, "min", lower, q25, q50, q75, upper, "max", outliers FROM (' + _iqr_sql("orders", ["o_totalprice"]) + ")",
)
def _(t):
    return P.box_statistics(t.orders, ["o_totalprice"])


@query(
    "Q19_split_audit",
    """WITH k AS (SELECT user_id, row_number() OVER (ORDER BY md5('42|' || user_id), user_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events)),
    s AS (SELECT user_id, CASE WHEN r <= floor(0.7::DOUBLE * n) THEN 'train' WHEN r <= floor(0.85::DOUBLE * n) THEN 'validation' ELSE 'test' END AS split FROM k),
    a AS (SELECT split, e.user_id, event_type, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label FROM events e JOIN s USING (user_id)),
    g AS (SELECT user_id, count(DISTINCT split) AS c FROM a GROUP BY 1), i AS (SELECT event_type, count(DISTINCT split) AS c FROM a GROUP BY 1)
    SELECT split, count(*) AS "rows", round(avg(label), 6) AS positive_rate, count(DISTINCT user_id) AS unique_groups,
           count(DISTINCT CASE WHEN g.c > 1 THEN user_id END) AS shared_groups, count(DISTINCT event_type) AS unique_items,
           count(DISTINCT CASE WHEN i.c > 1 THEN event_type END) AS shared_items
    FROM a JOIN g USING (user_id) JOIN i USING (event_type) GROUP BY split""",
)
def _(t):
    events = t.events.select("user_id", "event_type", (F.col("event_type") == "purchase").cast("int").alias("label"))
    return P.split_audit(sampling.split_groups(events, "user_id", 42), "split", "user_id", "event_type", "label")

"""Joins, grouped aggregates, ranks, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import hash_order
from ..operators import metrics as M
from ..operators import relational as L
from ..operators import stats as ST
from ..operators.ordered import hash_bucket, rank_by_value, running, top_k
from . import roles
from .registry import query


@query("J1_inner_join", "SELECT o_orderkey, o_custkey AS c_custkey, o_totalprice, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def _(t):
    orders = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return L.inner(orders, t.customer.select("c_custkey", "c_mktsegment"), ["c_custkey"])


@query(
    "J2_multi_key_join",
    """WITH a AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), b AS (SELECT user_id, event_type, max(value) AS n FROM events GROUP BY ALL)
    SELECT user_id, event_type, a.n AS n_x, b.n AS n_y FROM a JOIN b USING (user_id, event_type)""",
)
def _(t):
    keys = ["user_id", "event_type"]
    a = t.events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return L.inner(a, t.events.groupBy(*keys).agg(F.max("value").alias("n")), keys)


@query("J3_semi_join", "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 200)")
def _(t):
    wanted = t.events.where("event_type = 'purchase' and value > 200").select("user_id").distinct()
    return L.keep_members(t.events.select("event_id", "user_id"), wanted, ["user_id"])


@query(
    "J4_lookup_with_default",
    """WITH c AS (SELECT p_brand, count(*) AS n FROM part WHERE p_size > 40 GROUP BY 1 HAVING count(*) > 10)
    SELECT p_partkey, p_brand, coalesce(n, 0) AS n FROM part LEFT JOIN c USING (p_brand)""",
)
def _(t):
    counts = t.part.where("p_size > 40").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).where("n > 10")
    return L.lookup(t.part.select("p_partkey", "p_brand"), counts, "p_brand", "n", 0)


@query("J5_anti_join", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount > 0.09)")
def _(t):
    sold = t.lineitem.where("l_discount > 0.09").select(F.col("l_partkey").alias("p_partkey"))
    return L.drop_members(t.part.select("p_partkey"), sold, ["p_partkey"])


@query("J7_key_overlap", "SELECT count(*) AS shared FROM (SELECT user_id, event_type FROM events WHERE value > 100 INTERSECT SELECT user_id, event_type FROM events WHERE value <= 1)")
def _(t):
    return L.shared_keys(t.events.where("value > 100"), t.events.where("value <= 1"), ["user_id", "event_type"])


@query(
    "A1_grouped_aggregates",
    """SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 9) AS mean, round(stddev_samp(value), 6) AS std,
      arg_min(event_type, event_id) AS first_type, count(DISTINCT event_type) AS n_types FROM events GROUP BY user_id""",
)
def _(t):
    return t.events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("value"), 4).alias("total"),
        F.round(F.avg("value"), 9).alias("mean"),
        F.round(F.stddev_samp("value"), 6).alias("std"),
        F.min_by("event_type", "event_id").alias("first_type"),
        F.count_distinct("event_type").alias("n_types"),
    )


@query(
    "A2_multi_metric_aggregates",
    "SELECT l_returnflag, "
    + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std" for c in ("l_quantity", "l_discount", "l_tax"))
    + " FROM lineitem GROUP BY l_returnflag",
)
def _(t):
    return ST.mean_and(t.lineitem, ["l_returnflag"], ["l_quantity", "l_discount", "l_tax"], {"mean": F.avg, "std": F.stddev_samp})


@query(
    "A3_group_metric",
    f"""WITH {roles.SCORED}, g AS (SELECT event_type, count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp, count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) AS n FROM scored GROUP BY 1)
    SELECT event_type, n AS "rows", round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall,
    round(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM g""",
)
def _(t):
    out = M.binary_metrics(roles.scored(t), "label", "prediction", ["event_type"])
    return out.select("event_type", F.col("support").alias("rows"), "precision", "recall", "f1")


@query(
    "W1_rank_change",
    f"""WITH {roles.GRADED_EVENTS}, r AS (SELECT term_id, item_id, row_number() OVER (PARTITION BY term_id ORDER BY score DESC, item_id) AS rank_before, row_number() OVER (PARTITION BY term_id ORDER BY score_b DESC, item_id) AS rank_after FROM graded)
    SELECT *, rank_before - rank_after AS rank_change FROM r""",
)
def _(t):
    out = L.rank_change(roles.graded_events(t), "term_id", "item_id", "score", "score_b")
    return out.select("term_id", "item_id", "rank_before", "rank_after", "rank_change")


@query(
    "W1_rank_by_value_buckets",
    "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events",
)
def _(t):
    """The path for groups too large for one task, taken here on purpose."""
    return rank_by_value(t.events.select("user_id", "event_id", "value"), "value", "event_id", "rank", ["user_id"]).select(
        "user_id", "event_id", "rank"
    )


@query("W2_global_rank", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def _(t):
    return rank_by_value(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", "rank").select("o_orderkey", "rank")


@query("W3_dense_group_code", "SELECT event_id, user_id, CAST(dense_rank() OVER (ORDER BY user_id) - 1 AS INTEGER) AS code FROM events")
def _(t):
    return L.dense_codes(t.events.select("event_id", "user_id"), "user_id")


@query(
    "W4_running_total",
    """WITH g AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
    SELECT user_id, n, CAST(sum(n) OVER (ORDER BY md5('42|' || user_id), user_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM g""",
)
def _(t):
    sizes = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).withColumn("d", hash_order(42, "user_id"))
    return running(sizes, [F.col("d"), F.col("user_id")], {"upto": F.col("n")}, hash_bucket(F.col("d"))).drop("d")


@query(
    "W5_running_precision",
    f"""WITH {roles.GRADED_EVENTS}, r AS (SELECT term_id, item_id, row_number() OVER w AS rank, sum(label) OVER (PARTITION BY term_id ORDER BY score DESC, item_id ROWS UNBOUNDED PRECEDING) AS hits FROM graded WINDOW w AS (PARTITION BY term_id ORDER BY score DESC, item_id))
    SELECT term_id, item_id, rank, CAST(hits AS BIGINT) AS hits, round(hits::DOUBLE / rank, 6) AS precision FROM r""",
)
def _(t):
    out = rank_by_value(roles.graded_events(t), "score", "item_id", "rank", ["term_id"], extra={"hits": F.col("label")})
    return out.select("term_id", "item_id", "rank", "hits", F.round(F.col("hits") / F.col("rank"), 6).alias("precision"))


@query("O1_mixed_sort", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey")
def _(t):
    order = [F.asc("o_orderpriority"), F.desc("o_totalprice"), F.asc("o_orderkey")]
    return L.sort_rows(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), order)


@query(
    "O2_top_k_per_group",
    "SELECT user_id, event_id, value, row_number() OVER w AS rank FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id) QUALIFY row_number() OVER w <= 5",
)
def _(t):
    return top_k(t.events.select("user_id", "event_id", "value"), 5, [F.desc("value"), F.asc("event_id")], ["user_id"])


@query(
    "O3_extremes",
    """SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20)
    UNION SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20)""",
)
def _(t):
    return ST.extremes(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"], 20)


@query(
    "O4_zero_filled_levels",
    f"""WITH {roles.SCORED}, b AS (SELECT CASE WHEN p < 0.4 THEN 'Düşük' WHEN p < 0.7 THEN 'Orta' ELSE 'Yüksek' END AS band FROM scored),
    l AS (SELECT * FROM (VALUES (0, 'Düşük'), (1, 'Orta'), (2, 'Yüksek'), (3, 'Bilinmiyor')) v(position, band))
    SELECT position, band, (SELECT count(*) FROM b WHERE b.band = l.band) AS n FROM l""",
)
def _(t):
    from ..operators.clean import BANDS, risk_band

    counts = roles.scored(t).groupBy(risk_band("p").alias("band")).agg(F.count(F.lit(1)).alias("n"))
    return M.fill_levels(counts, [*BANDS, "Bilinmiyor"], "band")


@query(
    "U1_union_all",
    """SELECT o_orderkey AS id, o_totalprice AS amount, NULL AS name FROM orders UNION ALL SELECT c_custkey, c_acctbal, c_name FROM customer""",
)
def _(t):
    a = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    return L.stack(a, t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount"), F.col("c_name").alias("name")))

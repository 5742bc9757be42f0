import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriloom.operators import ordered as O
from veriloom.operators import relational as L


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one group, and many equal values."""
    rng = random.Random(1)
    rows = [(0 if i % 3 == 0 else rng.randrange(1, 40), i, float(rng.choice([1, 1, 1, 2, rng.randrange(500)]))) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "g int, id long, v double").repartition(4)


def brute_ranks(rows):
    groups = defaultdict(list)
    for g, i, v in rows:
        groups[g].append((-v, i))
    return {(g, i): r for g, items in groups.items() for r, (_, i) in enumerate(sorted(items), 1)}


def test_rank_by_value_matches_brute_force(skewed):
    rows, df = skewed
    out = O.rank_by_value(df, "v", "id", "rank", ["g"]).collect()
    assert {(r["g"], r["id"]): r["rank"] for r in out} == brute_ranks(rows)


def test_rank_by_hash_is_dense_and_stable(skewed):
    _, df = skewed
    a = {r["id"]: r["rank"] for r in O.rank_by_hash(df, ["id"], 7).collect()}
    b = {r["id"]: r["rank"] for r in O.rank_by_hash(df.repartition(2), ["id"], 7).collect()}
    assert a == b and sorted(a.values()) == list(range(1, 3001))


@pytest.mark.parametrize("most", [0, 5, 10**6])
def test_exact_quantiles(skewed, monkeypatch, most):
    rows, df = skewed
    monkeypatch.setattr(O, "SKETCH", 20)
    shares = [0.0, 0.1, 0.25, 0.5, 0.66, 0.9, 1.0]
    with_nulls = df.select("v", F.when(F.col("id") % 7 > 0, F.col("id")).alias("i"), F.lit(None).cast("int").alias("none"), (F.col("id") % 2).alias("two"))
    got = O.quantile_values(with_nulls, ["v", "i", "none", "two"], shares, most)
    values = {"v": [v for _, _, v in rows], "i": [i for _, i, _ in rows if i % 7], "two": [i % 2 for _, i, _ in rows]}
    assert got == {(c, s): pytest.approx(np.quantile(x, s)) for c, x in values.items() for s in shares}


def test_ranges_spread_a_hot_group(spark, skewed):
    rows, df = skewed
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stored = O.in_ranges(df, [F.desc("v"), F.asc("id")], ["g"])
        parts = stored.where("g = 0").groupBy("_bucket").count().collect()
        assert len(parts) >= 2 and max(r["count"] for r in parts) < 1000
        out = O.rank_by_value(df, "v", "id", "rank", ["g"])
        assert {(r["g"], r["id"]): r["rank"] for r in out.collect()} == brute_ranks(rows)
        curve = O.running_in_order(df.select("id"), [F.col("id")], {"n": F.lit(1)})
        assert {r["id"]: r["n"] for r in curve.collect()} == {i: i + 1 for i in range(3000)}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_group_join_with_hot_groups(skewed):
    rows, df = skewed
    groups = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    out = O.join_groups(df, groups, ["g"], "n")
    assert out.count() == len(rows)
    assert out.where("g = 0").select("n").distinct().collect()[0][0] == sum(1 for g, _, _ in rows if g == 0)


def test_dense_codes(skewed):
    rows, df = skewed
    order = {g: i for i, g in enumerate(sorted({g for g, _, _ in rows}))}
    assert all(order[r["g"]] == r["code"] for r in L.dense_codes(df, "g").collect())

from pyspark.sql import functions as F

from veriloom.operators import sampling as S


def grouped(spark):
    return spark.range(1000).select((F.col("id") % 50).alias("g"), "id", (F.col("id") % 4 == 0).cast("int").alias("label"))


def test_group_split_is_disjoint_and_deterministic(spark):
    df = grouped(spark)
    out = S.split_groups(df, "g", 42)
    assert out.count() == 1000
    per_group = out.groupBy("g").agg(F.count_distinct("split").alias("n"))
    assert per_group.where("n > 1").count() == 0
    sizes = {r["split"]: r["n"] for r in out.select("g", "split").distinct().groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"train": 35, "validation": 7, "test": 8}
    again = S.split_groups(df.repartition(7), "g", 42)
    assert out.exceptAll(again).count() == 0


def test_folds_are_balanced(spark):
    out = S.row_folds(grouped(spark), ["id"], 5, strata=["label"])
    sizes = [r["n"] for r in out.groupBy("label", "fold").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 10 and set(sizes) == {50, 150}


def test_group_sample_reaches_target(spark):
    out = S.sample_groups_to_rows(grouped(spark), "g", 110)
    assert out.count() == 120 and out.select("g").distinct().count() == 6


def test_stride_sample_keeps_required(spark):
    out = S.stride_sample(spark.range(1000), "id", spark.range(5), 19)
    assert out.where("id < 5").count() == 5
    assert 53 <= out.count() <= 58

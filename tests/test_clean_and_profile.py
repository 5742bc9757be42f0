import pytest
from pyspark.sql import functions as F

from veriloom.operators import clean as C
from veriloom.operators import contracts as K
from veriloom.operators import metrics as M
from veriloom.operators import profile as P
from veriloom.session import scratch_path
from veriloom.sources import files


def test_null_never_breaks_a_rule(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, -1.0)], "id int, v double")
    assert [r["id"] for r in C.keep_valid(df, [F.col("v") <= 0]).orderBy("id").collect()] == [1, 2]


def test_imputation(spark):
    df = spark.createDataFrame([(1.0, "b"), (None, "a"), (2.0, None), (5.0, "a"), (4.0, "b")], "v double, c string")
    out = C.impute_mode(C.impute_median(df, ["v"]), ["c"]).collect()
    assert out[1]["v"] == 3.0 and out[2]["c"] == "a"


def test_bands_are_left_closed(spark):
    df = spark.createDataFrame([(0.39,), (0.4,), (0.7,)], "p double")
    assert [r[0] for r in df.select(C.risk_band("p")).collect()] == C.BANDS


def test_duplicates_count_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    r = P.duplicate_rows(df).first()
    assert (r["rows"], r["duplicates"]) == (3, 1)


def test_catalogue_contract(spark):
    df = spark.createDataFrame([("b", 0, "x"), ("a", 1, "y"), ("a", 2, "z"), (None, 3, "n"), ("c", 4, " ")], "id string, o int, title string")
    out = K.prepare_catalogue(df, "id", ["o"], ["title"]).orderBy("id").collect()
    assert [(r["id"], r["title"]) for r in out] == [("a", "y"), ("b", "x")]


def test_fingerprint_ignores_order_but_not_copies(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 7)
    a = K.content_fingerprint(df, ["id", "v"]).first()
    assert a == K.content_fingerprint(df.repartition(5), ["id", "v"]).first()
    assert a != K.content_fingerprint(df.union(df.limit(1)), ["id", "v"]).first()


def test_record_assembly(spark):
    lines = spark.createDataFrame([("f", 0, "part one"), ("f", 1, "part two\t1"), ("f", 2, "single\t0"), ("f", 3, "tail")], "s string, n int, l string")
    out = files.assemble_records(lines, "s", "n", "l").orderBy("record").collect()
    assert [(r["text"], r["label"]) for r in out] == [("part one part two", "1"), ("single", "0"), ("tail", None)]


@pytest.mark.parametrize("sep", [";", ","])
def test_delimiter_detection(spark, sep):
    path = scratch_path(spark, "csv")
    spark.range(3).withColumn("b", F.lit("x")).write.option("header", True).option("sep", sep).csv(path)
    assert files.read_delimited(spark, path).columns == ["id", "b"]


def test_ranking_areas_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "y int, p double")
    for small in (0, 10):
        r = M.ranking_areas(df, "y", "p").first()
        assert r["roc_auc"] == 0.625 + 0.0 and r["average_precision"] == pytest.approx(0.583333, abs=1e-6)

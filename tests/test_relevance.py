"""Fitted features, stacked scores, cross-fitted calibration, ranking rounds, file facts, long passages."""

import gzip
import types

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from veriloom.operators import models as D
from veriloom.operators import relevance as V
from veriloom.plans import roles
from veriloom.session import scratch_path
from veriloom.sources import files

PAIRS = "term_id long, item_id long, query string, title string, category string, brand string, gender string, age_group string, attributes string"


def pairs(spark, n=30):
    rows = [
        (k % 5, k, f"kırmızı elbise {k % 5}", f"elbise kırmızı {k % 3} uzun", "giyim" if k % 3 else None, f"marka{k % 4}", None, "yetişkin", "renk kırmızı")
        for k in range(n)
    ]
    return spark.createDataFrame(rows, PAIRS)


def test_dense_features_survive_a_save(spark):
    train = pairs(spark)
    model = V.DenseFeatures().fit(train)
    path = scratch_path(spark, "dense")
    Pipeline(stages=[]).fit(train)
    PipelineModel([model]).write().save(path)
    loaded = PipelineModel.load(path)
    new = train.limit(3).unionByName(train.limit(1).withColumns({"query": F.lit("yeni"), "category": F.lit("ev"), "brand": F.lit(None).cast("string")}))
    a, b = (sorted(map(str, m.transform(new).collect())) for m in (model, loaded))
    assert a == b and len(a) == 4
    rows = {(r["query"], r["item_id"]): r for r in loaded.transform(new).collect()}
    fresh = next(r for q, r in rows.items() if q[0] == "yeni")
    assert (fresh["query_train_frequency"], fresh["category_code"], fresh["brand_missing"], fresh["brand_code"]) == (0, 0, 1, 0)
    known = next(r for q, r in rows.items() if q[0] != "yeni")
    assert known["query_train_frequency"] == 6 and known["gender_code"] == 1 and known["gender_missing"] == 1 and known["age_group_missing"] == 0
    counts = {r["category"]: r["category_code"] for r in model.transform(train).collect()}
    assert counts == {"giyim": 1, None: 2}
    assert model.names() == loaded.stages[0].names() and len(model.names()) == 15 + 2 + 8 + 4


def test_dense_cosines_match_the_plain_operator(spark):
    from veriloom.functions import text as T
    from veriloom.operators.features import pair_cosine

    train = pairs(spark)
    normal = train.withColumns({"l": T.normalize_basic("query"), "r": T.normalize_basic("title")})
    want = {r["item_id"]: r["cosine"] for r in pair_cosine(normal, "item_id", "l", "r").collect()}
    got = {r["item_id"]: r["word_cosine"] for r in V.DenseFeatures().fit(train).transform(train).collect()}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


def labelled(spark, n=300):
    """A feature that is the label inside a fold's own rows only: a model that saw a row would know it."""
    return spark.range(n).select(
        "id", (F.col("id") % 3).cast("int").alias("fold"), (F.pmod(F.xxhash64("id"), F.lit(2)) == 0).cast("int").alias("label"),
        F.rand(3).alias("x"),
    )


def test_no_row_is_scored_by_a_model_that_saw_it(spark, monkeypatch):
    from pyspark.ml.pipeline import Pipeline as Plain

    df, seen = labelled(spark).cache(), []
    fit = Plain.fit

    def watched(self, data, *args):
        model = fit(self, data, *args)
        model.saw = {r["id"] for r in data.select("id").collect()}
        return model

    scores = D.with_scores

    def checked(model, rows, name="score"):
        ids = {r["id"] for r in rows.select("id").collect()}
        assert not ids & model.saw
        seen.append(len(ids))
        return scores(model, rows, name)

    monkeypatch.setattr(Plain, "fit", watched)
    monkeypatch.setattr(D, "with_scores", checked)
    stages = [VectorAssembler(inputCols=["x"], outputCol="features"), D.classifier("logistic_regression")]
    train, holdout = df.where("id < 240"), df.where("id >= 240")
    level, others = V.stacked_scores(train, {"holdout": holdout}, {"s": stages}, "id", "fold", 3)
    assert level.count() == 240 and others["holdout"].count() == 60 and seen == [80, 80, 80]
    assert level.where("s is null").count() == 0 == others["holdout"].where("s is null").count()


def test_calibrators_do_not_see_what_they_are_judged_on(spark):
    df = spark.range(900).select(
        "id", (F.col("id") % 3).cast("int").alias("fold"), (F.rand(1) * 4).alias("x"), F.rand(2).alias("u"),
    ).withColumn("label", (F.col("u") < F.col("x") / 4).cast("int")).cache()
    train, rows = df.where("id < 600"), df.where("id >= 600").drop("fold")
    stages = [VectorAssembler(inputCols=["x"], outputCol="features"), D.classifier("linear_svc")]
    for method in ("sigmoid", "isotonic"):
        out = V.cross_calibrated(train, rows, stages, "label", "fold", 3, method)
        assert out.columns == [*rows.columns, "calibrated"] and out.count() == 300
        near = out.agg(F.avg(F.abs(F.col("calibrated") - F.col("x") / 4)).alias("e"), F.min("calibrated").alias("a"), F.max("calibrated").alias("b")).first()
        assert near["e"] < 0.1 and 0 <= near["a"] < near["b"] <= 1


@pytest.mark.parametrize(("objective", "top"), [("pairwise", None), ("ndcg", None), ("ndcg", 2), ("map", None)])
def test_ranking_rounds_learn_the_order(spark, objective, top):
    df = spark.range(120).select(
        (F.col("id") % 6).alias("g"), "id", (F.pmod(F.xxhash64("id"), F.lit(4)) == 0).cast("int").alias("y"), F.rand(5).alias("noise")
    ).withColumns({"good": F.col("y") + F.rand(6) / 2, "first": F.rand(7)})
    df = df.cache()
    model = V.fit_ranking_rounds(df, "g", "id", "y", ["good", "noise"], "first", objective, top, rounds=2)
    weights = model.stages[-1].coefficients.toArray()
    assert weights[0] > abs(weights[1])


def test_a_broken_file_is_a_row(spark, tmp_path):
    spark.range(7).withColumnRenamed("id", "a").coalesce(1).write.parquet(str(tmp_path / "good"))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_bytes(b"PAR1 not really")
    (tmp_path / "text").mkdir()
    (tmp_path / "text" / "a.csv").write_text('h;i\n1;"two\nlines"\n3;4\n')
    (tmp_path / "text" / "b.csv.gz").write_bytes(gzip.compress(b"h,i\n1,2\n"))
    (tmp_path / "text" / "c.jsonl").write_text('{"a": 1}\n\n{"a": 2, "b": 3}\n')
    (tmp_path / "text" / "d.json").write_text("{broken\n")
    (tmp_path / "text" / "e.bin").write_bytes(b"123")
    out = files.file_inventory(spark, {n: str(tmp_path / n) for n in ("good", "bad", "text")}).collect()
    got = {r["file_name"] if r["table_name"] != "good" else r["extension"]: (r["readable"], r["row_count"], r["columns"]) for r in out if r["size_bytes"]}
    assert got == {
        ".parquet": (True, 7, "a"), "x.parquet": (False, None, None), "a.csv": (True, 2, "h,i"), "b.csv.gz": (True, 1, "h,i"),
        "c.jsonl": (True, 2, "a,b"), "d.json": (False, None, None), "e.bin": (True, None, None),
    }
    assert all(len(r["sha256"]) == 64 for r in out)


def test_long_texts_are_judged_in_time(spark):
    import time

    words = " ".join(f"w{k * 7919 % 10007}" for k in range(20_000))
    passage = " ".join(words.split()[9_000:9_040])
    t = types.SimpleNamespace(
        spark=spark,
        documents=spark.createDataFrame([(1, words), (2, "other"), (3, None)], "doc_id long, text string"),
        benchmark=spark.createDataFrame([(5, passage), (6, ""), (7, None)], "item_id long, text string"),
    )
    start = time.time()
    assert {(r["term_id"], r["item_id"]) for r in roles._judgments(t).collect()} == {(5, 1), (6, 1), (6, 2)}
    assert time.time() - start < 30

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from veriloom.functions.text import normalize_basic
from veriloom.operators import models as D
from veriloom.operators import scoring as B
from veriloom.session import scratch_path
from veriloom.streaming import stateless


def toy(spark):
    return spark.range(200).select(
        "id",
        F.when(F.col("id") % 11 != 0, (F.col("id") % 20).cast("double")).alias("x"),
        F.when(F.col("id") % 7 != 0, F.concat(F.lit("c"), (F.col("id") % 3).cast("string"))).alias("kind"),
        (F.col("id") % 20 > 9).cast("int").alias("label"),
    )


def test_fit_save_load_and_stream(spark):
    df = toy(spark)
    model = Pipeline(stages=[*D.tabular_stages(["x"], ["kind"]), D.classifier("logistic_regression")]).fit(df)
    path = scratch_path(spark, "model")
    D.save_model(model, path, {"seed": 42})
    loaded, metadata = D.load_model(spark, path)
    assert metadata == {"seed": 42}
    batch = B.score_customers(loaded, df)
    assert D.classification_summary(D.with_scores(loaded, df), "label").first()["roc_auc"] > 0.9
    source, sink, check = (scratch_path(spark, n) for n in ("in", "out", "ckpt"))
    df.write.parquet(source)
    stream = stateless.read_table_stream(spark, source, df.schema)
    steps = [lambda s: B.score_customers(loaded, s), lambda s: s.withColumn("kind", normalize_basic("kind"))]
    stateless.write_available(stateless.apply_steps(stream, steps), sink, check).awaitTermination(120)
    got = spark.read.parquet(sink)
    assert got.count() == 200
    diff = got.select("id", "risk_band").exceptAll(batch.select("id", "risk_band"))
    assert diff.count() == 0


def test_text_features_match_formula(spark):
    import math

    df = spark.createDataFrame([(0, "aa bb"), (1, "aa aa cc"), (2, "bb")], "id long, text string")
    out = Pipeline(stages=D.text_stages("text", "f", min_df=1.0)).fit(df).transform(df)
    vocab = Pipeline(stages=D.text_stages("text", "f", min_df=1.0)).fit(df).stages[1].vocabulary
    row = {vocab[i]: v for i, v in zip(*(lambda v: (v.indices, v.values))(out.where("id = 2").first()["f"]))}
    assert row == {"bb": 1.0}
    two = {vocab[i]: v for i, v in zip(*(lambda v: (v.indices, v.values))(out.where("id = 1").first()["f"]))}
    raw = {"aa": (1 + math.log(2)) * (math.log(4 / 3) + 1), "cc": math.log(4 / 2) + 1, "aa aa": math.log(4 / 2) + 1, "aa cc": math.log(4 / 2) + 1}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    assert all(abs(two[k] - raw[k] / norm) < 1e-9 for k in raw)


def test_text_vocabulary_is_cut_by_a_rule(spark):
    """Equally frequent terms were kept by chance, from lists of all terms that a partition held at once."""
    import random

    terms = [f"w{i:02d}" for i in range(40)]
    shuffled = [random.Random(s).sample(terms, 40) for s in range(3)]
    df = spark.createDataFrame([(" ".join(x),) for x in shuffled], "text string").repartition(7)
    model = Pipeline(stages=D.text_stages("text", "f", max_features=5)).fit(df)
    assert model.stages[1].vocabulary == terms[:5]
    path = scratch_path(spark, "text-model")
    model.write().save(path)
    again = type(model).load(path).transform(df).select("text", "f").collect()
    assert sorted(map(str, again)) == sorted(map(str, model.transform(df).select("text", "f").collect()))
    assert all(v.size == 5 and abs(v.norm(2) - 1) < 1e-12 for _, v in again)


def test_blocks_are_fitted_once_and_equal_the_stages(spark):
    rows = [(i, f"red shoe {i % 3}", f"blue red hat no{i % 4} shoe", i % 2, "train" if i % 5 else "test") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, q string, p string, x int, split string").withColumn("pp", F.concat_ws(" ", "q", "p"))
    fit, names = F.col("split") == "train", ["q", "p", "pp"]
    stored = D.stored_blocks(df, ["id"], fit, D.relevance_blocks("combined", *names))
    for name in ("word", "char", "combined"):
        stages = D.relevance_stages(name, *names, ["x"])
        whole = Pipeline(stages=stages).fit(df.where(fit)).transform(df).select("id", "features")
        assert sorted(map(str, stages[-1].transform(stored).select("id", "features").collect())) == sorted(map(str, whole.collect()))


def test_stored_features_carry_no_slot_names(spark):
    """Names of 92,000 slots went to the tasks with every iteration of a fit."""
    df = spark.range(20).select("id", (F.col("id") % 2).alias("label"), F.lit(1.0).alias("x"))
    assembler = D.relevance_stages("none", "q", "p", "pp", ["id", "x"])[-1]
    out = D.stored_features(df, assembler, ["label"])
    assert out.schema["features"].metadata == {} and assembler.transform(df).schema["features"].metadata
    assert sorted(map(str, out.select("features").collect())) == sorted(map(str, assembler.transform(df).select("features").collect()))

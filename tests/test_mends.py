"""Cases that earlier versions got wrong."""

import hashlib
import json
import types

import pytest
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml import Pipeline
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from veriloom import session
from veriloom.operators import contracts, features, models, relevance, sampling, scoring, stats
from veriloom.operators import retrieval as R
from veriloom.plans import roles
from veriloom.sources import files


def test_pair_keys_may_hold_separators(spark):
    df = spark.createDataFrame([("a|b", "red shoe red", "red shoe red"), ("a", "red shoe", "blue hat"), ("b|l", "blue hat", "blue hat")], "k string, x string, y string")
    got = {r["k"]: round(r["cosine"], 6) for r in features.pair_cosine(df, "k", "x", "y").collect()}
    assert got == {"a|b": 1.0, "a": 0.0, "b|l": 1.0}


def test_vocabulary_is_whole_unless_cut(spark):
    counts = spark.createDataFrame([(d, f"t{t}", 1) for d in range(2) for t in range(50)], "d int, term string, tf int")
    assert features.vocabulary(counts).count() == 50 and features.vocabulary(counts, max_features=7).count() == 7


def test_fingerprints_tell_values_apart(spark):
    def digest(*row):
        return contracts.content_fingerprint(spark.createDataFrame([row], "a string, b string"), ["a", "b"]).first()["fingerprint"]

    assert len({digest(*r) for r in [("a|b", "c"), ("a", "b|c"), ("∅", "c"), (None, "c"), ("-;", "c"), ("", "c")]}) == 6


@pytest.mark.parametrize("n, t", [(2, 12.706), (21, 2.086), (22, 2.080), (31, 2.042), (121, 1.980)])
def test_intervals_use_the_right_point(spark, n, t):
    df = spark.createDataFrame([(k, float(k % 2)) for k in range(n)], "seed int, m double")
    r = stats.seed_intervals(df, [], ["m"]).first()
    half = (r["m_ci_high"] - r["m_ci_low"]) / 2
    assert half == pytest.approx(t * r["m_std"] / n**0.5, abs=2e-4 * t)


def test_one_seed_promotes_nothing(spark):
    r = stats.promotion_decision(stats.seed_intervals(spark.createDataFrame([(1, 0.5)], "seed int, m double"), [], ["m"]), "m_ci_low").first()
    assert r["m_ci_low"] is None and r["m_ci_high"] is None and r["decision"] == "retain"


def test_missing_rows_and_nulls_are_changes(spark):
    new = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0), (None, 4.0), (5, None)], "k int, m double")
    old = spark.createDataFrame([(1, 1.0), (2, 2.0), (4, 3.0), (None, 4.0), (5, None)], "k int, m double")
    r = stats.unchanged_check(new, old, ["k"], ["m"]).first()
    assert (r["compared"], r["changed"]) == (6, 3)


def test_short_passages_are_judged(spark):
    docs = [(1, "zero one two three four five"), (2, "one two"), (3, "someone twofold"), (4, "a b c d e f g h i j"), (5, "nothing")]
    items = [(10, "one two three four"), (11, "one two"), (12, "three"), (13, "b c d e f g h i"), (14, "eno")]
    t = types.SimpleNamespace(
        spark=spark,
        documents=spark.createDataFrame(docs, "doc_id long, text string"),
        benchmark=spark.createDataFrame(items, "item_id long, text string"),
    )
    got = {(r["term_id"], r["item_id"]) for r in roles._judgments(t).collect()}
    assert got == {(i, d) for i, p in items for d, x in docs if p in x}


def test_delimiters_inside_quotes_do_not_count(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"x;y;z",b\n1,2\n')
    assert files.detect_delimiter(spark, str(tmp_path / "a.csv")) == ","
    assert files.read_delimited(spark, str(tmp_path / "a.csv")).columns == ["x;y;z", "b"]


def test_bootstrap_is_about_the_mean(spark):
    df = spark.createDataFrame([("g", k, float(k % 10)) for k in range(400)], "g string, q int, delta double")
    r = stats.paired_bootstrap(df, "q", ["g"]).first()
    half = 1.96 * (8.25 / 400) ** 0.5
    assert r["ci_low"] == pytest.approx(4.5 - half, abs=0.05) and r["ci_high"] == pytest.approx(4.5 + half, abs=0.05)


def test_margins_are_not_called_probabilities(spark):
    df = spark.createDataFrame([(float(k), float(k > 5)) for k in range(12)], "x double, label double")
    pack = VectorAssembler(inputCols=["x"], outputCol="features")
    for learner, kind in ((LinearSVC(maxIter=5), "margin"), (LogisticRegression(maxIter=5), "probability")):
        model = Pipeline(stages=[pack, learner]).fit(df)
        assert {r["score_type"] for r in scoring.score_relevance(model, df).collect()} == {kind}
        with pytest.raises(ValueError):
            scoring.score_relevance(model, df, "margin" if kind == "probability" else "probability")


def test_pair_weights_are_metric_changes(spark):
    rows = [("q", k, int(k in (3, 5)), float(k)) for k in range(1, 7)]
    df = spark.createDataFrame(rows, "g string, item int, y int, f double")
    labels = [y for _, _, y, _ in rows]

    def precision(order):
        hits, total = 0, 0.0
        for k, y in enumerate(order, 1):
            hits += y
            total += y * hits / k
        return total / sum(order)

    for top in (None, 2):
        got = relevance.weighted_pairs(df.withColumn("s", -F.col("item")), "g", "item", "y", ["f"], "s", "map", top).collect()
        assert len(got) == (8 if top is None else 4)
        for r in got:
            swapped = list(labels)
            p, n = r["positive"] - 1, r["negative"] - 1
            assert (r["rank_pos"], r["rank_neg"]) == (p + 1, n + 1) and r["d_f"] == p - n
            assert top is None or min(p, n) < top
            swapped[p], swapped[n] = swapped[n], swapped[p]
            assert r["pair_weight"] == pytest.approx(abs(precision(swapped) - precision(labels)) + 1e-6)


def test_a_cluster_must_name_its_shared_folder():
    context = types.SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None, applicationId="a")
    fake = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(ValueError):
        session.shared_folder(fake)


@pytest.mark.parametrize("most", [1, 50_000])
def test_splits_cut_at_exact_positions(spark, monkeypatch, most):
    import hashlib

    monkeypatch.setattr(sampling, "ORDERED_KEYS", most)
    df = spark.range(997).withColumnRenamed("id", "k")
    order = sorted(range(997), key=lambda k: hashlib.md5(f"42|{k}".encode()).hexdigest())
    want = {k: "train" if r < int(0.7 * 997) else "validation" if r < int(0.85 * 997) else "test" for r, k in enumerate(order)}
    assert {r["k"]: r["split"] for r in sampling.split_rows(df, ["k"], (0.7, 0.85), ("train", "validation", "test")).collect()} == want
    twice = df.unionByName(df)
    assert {r["k"]: r["split"] for r in sampling.split_groups(twice, "k").collect()} == want
    assert sampling.holdout_groups(df.limit(0), "k").count() == 0


def test_tables_for_fits_bound_the_rows_of_a_file(spark):
    t = types.SimpleNamespace(spark=spark, folder="few-rows")
    out = roles.stored(t, "few_rows", lambda: spark.range(0, 100, 1, 2), 10)
    per_file = out.groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()
    assert sorted(r["n"] for r in per_file) == [10] * 10 and out.distinct().count() == 100


def test_lines_meet_their_parts_without_a_sort(spark, folder):
    from veriloom.plans import model_queries
    from veriloom.plans.registry import Tables

    plan = model_queries._priced_lines(Tables(spark, folder))._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_words_are_indexed_from_the_counts_of_word_pairs(spark):
    """Both indexes of one table tokenised it; the narrow one now takes the counts of the wide one."""
    docs = spark.createDataFrame([(1, "red blue red"), (2, "blue green"), (3, None), (4, "red blue"), (5, "x")], "d int, text string")
    more = spark.createDataFrame([(6, "green blue old"), (7, "old red")], "d int, text string")
    wide, direct = (R.build_index(docs, "d", "text", ngrams=n) for n in (2, 1))
    grown = [R.append_documents(i, more, "text") for i in (wide, direct)]
    for source, wanted in ((wide, direct), grown):
        narrow = R.build_word_index(source)
        assert (narrow.n_docs, narrow.mean_length, narrow.fingerprint) == (wanted.n_docs, wanted.mean_length, wanted.fingerprint)
        for table in ("postings", "terms"):
            rows = [sorted(tuple(round(x, 12) if isinstance(x, float) else x for x in r) for r in getattr(i, table).collect()) for i in (narrow, wanted)]
            assert rows[0] == rows[1] and rows[0]


def test_counts_know_the_documents_of_a_term(spark):
    """Terms were counted again and joined back twice; sorting by bucket found the bucket anew in every comparison."""
    index = R.build_index(spark.createDataFrame([(1, "red blue"), (2, "red old"), (3, "red")], "d int, text string"), "d", "text")
    counts = spark.read.parquet(f"{index.path}/counts/batch=0").where("term = 'red'")
    assert [r["df"] for r in counts.collect()] == [3, 3, 3]
    described = {r[0]: r[1] for r in spark.sql(f"DESCRIBE EXTENDED index_{hashlib.md5(f'{index.path}/generation=0/postings'.encode()).hexdigest()}").collect()}
    assert described["Bucket Columns"] == "[`term`]" and described.get("Sort Columns", "[]") == "[]"


@pytest.mark.parametrize("name", ["random_forest", "extra_trees"])
def test_levels_of_a_forest_start_where_the_last_one_ended(spark, name):
    """Every level passed all rows down all trees from their roots."""
    rows = [(float(i % 17), float(i * 7 % 23), float((i % 17) * (i * 7 % 23) % 3 == 0)) for i in range(600)]
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(rows, "a double, b double, label double"))
    df = df.coalesce(1)
    forest = models.classifier(name, numTrees=8, maxDepth=7)
    plain = forest.copy({forest.cacheNodeIds: False}).fit(df)
    trees = [m.toDebugString.split("\n", 1)[1] for m in (forest.fit(df), plain)]
    assert forest.getCacheNodeIds() and trees[0] == trees[1]


def _folded(spark):
    rows = [(i, float(i * 7 % 31) if i % 13 else None, f"c{i % 3}", int((i * 7 % 31 + i % 5) > 16), i % 2) for i in range(160)]
    return spark.createDataFrame(rows, "id int, x double, kind string, label int, fold int").coalesce(1)


def test_a_grid_fits_shared_stages_once_per_fold(spark, monkeypatch):
    """Every setting fitted the median, scale and codes of its training rows again; the results are those of Spark's cross-validator."""
    df, lr, evaluator = _folded(spark), LogisticRegression(maxIter=10), BinaryClassificationEvaluator()
    stages, fits = models.tabular_stages(["x"], ["kind"]), []
    monkeypatch.setattr(models.ModeImputer, "_fit", lambda self, data, fit=models.ModeImputer._fit: fits.append(1) or fit(self, data))
    best, table = models.grid_search(df, [*stages, lr], [(lr.regParam, [0.01, 1.0, 0.1])], evaluator, "fold", 2)
    assert len(fits) == 3  # two folds and the best model
    maps = ParamGridBuilder().addGrid(lr.regParam, [0.01, 1.0, 0.1]).build()
    plain = CrossValidator(estimator=Pipeline(stages=[*stages, lr]), estimatorParamMaps=maps, evaluator=evaluator, foldCol="fold", numFolds=2).fit(df)
    got = {json.loads(r["params"])["regParam"]: (r["mean_value"], r["std_value"]) for r in table.collect()}
    assert [got[p] for p in (0.01, 1.0, 0.1)] == [pytest.approx(x) for x in zip(plain.avgMetrics, plain.stdMetrics)]
    assert best.stages[-1].coefficients.toArray() == pytest.approx(plain.bestModel.stages[-1].coefficients.toArray())


def test_candidates_share_the_stages_of_a_fold(spark, monkeypatch):
    df, stages, fits = _folded(spark), models.tabular_stages(["x"], ["kind"]), []
    monkeypatch.setattr(models.ModeImputer, "_fit", lambda self, data, fit=models.ModeImputer._fit: fits.append(1) or fit(self, data))
    names = ("logistic_regression", "decision_tree")
    shared = models.cross_validate(df, {n: [models.classifier(n)] for n in names}, "label", "fold", 2, stages)
    assert len(fits) == 2
    alone = models.cross_validate(df, {n: [*stages, models.classifier(n)] for n in names}, "label", "fold", 2)
    assert sorted(shared.collect()) == sorted(alone.collect()) and shared.count() == 4

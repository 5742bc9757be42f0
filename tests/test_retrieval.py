import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from veriloom.operators import fusion as U
from veriloom.operators import metrics as M
from veriloom.operators import retrieval as R
from veriloom.operators import stats as ST

DOCS = [(0, "kablosuz kulaklık siyah"), (1, "kırmızı elbise"), (2, "kablosuz mouse"), (3, "kırmızı mouse kulaklık")]


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "q long, text string")


def index(spark, **kw):
    return R.build_index(spark.createDataFrame(DOCS, "d long, text string"), "d", "text", **kw)


@pytest.mark.parametrize("search", [R.search_tfidf, R.search_bm25])
def test_best_document_first_and_padding(spark, search):
    out = search(index(spark), queries(spark, "kablosuz kulaklık", "yok"), "q", "text", 2).collect()
    first = {r["q"]: r["d"] for r in out if r["rank"] == 1}
    assert first[0] == 0
    assert sorted((r["d"], r["score"]) for r in out if r["q"] == 1) == [(0, 0.0), (1, 0.0)]


def test_bm25_against_formula(spark):
    out = {r["d"]: r["score"] for r in R.search_bm25(index(spark, min_df=1), queries(spark, "mouse"), "q", "text", 4, pad=False).collect()}
    lengths = {d: len(t.split()) for d, t in DOCS}
    avg, idf = sum(lengths.values()) / 4, math.log(1 + (4 - 2 + 0.5) / 2.5)
    for d in (2, 3):
        assert out[d] == pytest.approx(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * lengths[d] / avg)), abs=1e-8)
    assert set(out) == {2, 3}


def test_open_index_searches_without_building(spark, tmp_path):
    """Another session knows no tables; it registers the stored ones and reads the buckets of the query terms."""
    from veriloom.operators import lexical as L

    rows = [(n, " ".join(f"w{(n * 7 + k * k) % 97}" for k in range(30))) for n in range(60)]
    path = tmp_path.as_uri()
    built = R.write_index(spark.createDataFrame(rows[:40], "d long, text string"), "d", "text", path)
    grown = R.append_documents(built, spark.createDataFrame(rows[40:], "d long, text string"), "text")
    q = queries(spark, "w3 w50 w8", "w12")
    want = R.search_bm25(R.build_index(spark.createDataFrame(rows, "d long, text string"), "d", "text"), q, "q", "text", 5).collect()
    for index in (built, grown):
        for name in ("postings", "terms"):
            spark.sql(f"DROP TABLE {L._table_name(f'{path}/generation={index.generation}/{name}')}")
    again = R.open_index(spark, path)
    assert (again.generation, again.n_docs, again.fingerprint) == (1, 60, grown.fingerprint) and built.fingerprint != grown.fingerprint
    assert sorted(map(tuple, R.search_bm25(again, q, "q", "text", 5).collect())) == sorted(map(tuple, want))
    terms = L.bm25_scoring(again, q, "q", "text").terms
    plan = L._of_terms(again, again.postings, terms).join(terms.hint("merge"), "term")._jdf.queryExecution().toString()
    physical = plan[plan.index("Physical Plan") :]
    branch = physical[physical.index("SortMergeJoin") : physical.index("SelectedBucketsCount: 4 out of 32")]
    assert "weight" in branch and "Exchange" not in branch


def test_bounds_leave_few_pairs_and_lose_none(spark):
    import random

    from veriloom.operators import lexical as L

    r = random.Random(4)
    common, rare = [f"c{k}" for k in range(12)], [f"r{k}" for k in range(400)]
    rows = [(n, " ".join(r.choices(common, k=r.randrange(4, 30)) + r.choices(rare, k=3))) for n in range(600)]
    asked = [" ".join(r.sample(common, 5) + r.sample(rare, 3)) for _ in range(40)]
    index_ = R.build_index(spark.createDataFrame(rows, "d long, text string"), "d", "text", min_df=1)
    q = queries(spark, *asked)
    df, lengths = {}, {d: len(t.split()) for d, t in rows}
    for _, t in rows:
        for w in set(t.split()):
            df[w] = df.get(w, 0) + 1
    avg = sum(lengths.values()) / len(rows)

    def bm25(text, document, d):
        words, total = document.split(), 0.0
        for w in set(text.split()):
            tf = words.count(w)
            total += math.log(1 + (600 - df.get(w, 0) + 0.5) / (df.get(w, 0) + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * lengths[d] / avg)) if tf else 0
        return round(total, 9)

    want = {(n, d, s) for n, text in enumerate(asked) for s, d in sorted(((bm25(text, t, d), d) for d, t in rows), key=lambda x: (-x[0], x[1]))[:3]}
    got = {(x["q"], x["d"], x["score"]) for x in R.search_bm25(index_, q, "q", "text", 3).collect()}
    assert {(a, b) for a, b, _ in got} == {(a, b) for a, b, _ in want}
    kept, _ = L.candidates([L.bm25_scoring(index_, q, "q", "text")], "q", "d", 3)
    assert kept.count() < 40 * 600 / 20


def test_every_match_in_blocks_of_queries(spark, monkeypatch):
    """Words that are all about as frequent leave nothing to the bounds: postings meet their queries where the documents are."""
    import random

    from veriloom.operators import lexical as L

    r = random.Random(7)
    rows = [(n, " ".join(r.choices([f"w{k}" for k in range(20)], k=25))) for n in range(120)]
    index_ = R.build_index(spark.createDataFrame(rows, "d long, text string"), "d", "text", min_df=1)
    q = queries(spark, *[" ".join(r.sample([f"w{k}" for k in range(20)], 8)) for _ in range(6)])
    parts = L._floored([L.bm25_scoring(index_, q, "q", "text")], "q", "d", 5)
    assert not L._bounds_help(parts, "q")
    monkeypatch.setattr(L, "ASKED_ROWS", 20)
    got = {(x["q"], x["d"]): x["score"] for x in L._every_match(parts, "q", "d").collect()}
    want = {(x["q"], x["d"]): x["s"] for x in L._summed(L._gains(parts, "q", "d", F.lit(True)), "q", "d", "s").collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    plan = L._every_match(parts, "q", "d")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(q" not in plan  # sums need no exchange of their own


def test_texts_are_encoded_once_with_bounded_memory(spark):
    docs = spark.createDataFrame([(n, f"one word{n} two") for n in range(5)], "d long, text string")
    encoded = R.encode_texts(docs, "text", "passage", R.hashing_encoder(8), 8)
    plan = R._blocks(encoded, "d", "embedding", 4, "doc")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1
    place = next(c.cell_contents for c in R.hashing_encoder(8)().__closure__ if hasattr(c.cell_contents, "cache_info"))
    assert place.cache_info().maxsize


def test_documents_alike_are_scored_once(spark, tmp_path, monkeypatch):
    """Copies, also in other word order and from a later batch, enter by id beside the one that is scored."""
    from veriloom.operators import lexical as L

    texts = ["red hot bolt", "bolt red hot", "red bolt", "cold nut", "red red bolt", "old red gear", "", None]
    rows = [(n, texts[n * n % 8 if n < 20 else n % 8]) for n in range(160)]
    docs = spark.createDataFrame(rows, "d long, text string")
    path = tmp_path.as_uri()
    R.append_documents(R.write_index(docs.where("d % 3 = 0"), "d", "text", path), docs.where("d % 3 > 0"), "text")
    q = queries(spark, "red bolt", "nut", "hot gear", "red")
    plain = R.build_index(docs, "d", "text")
    bags = {}
    for n, text in rows:
        bags.setdefault(tuple(sorted((text or "").split())), []).append(n)
    assert sorted(map(tuple, plain.copies.collect())) == sorted((same[0], n) for words, same in bags.items() if words for n in same[1:])
    pairs = L._every_match([L.bm25_scoring(plain, q, "q", "text")], "q", "d")
    assert pairs.count() <= 4 * 5  # five sets of words and counts, not 120 documents
    everyone = replace(plain, postings=plain.postings.withColumn("single", F.lit(True)), copies=plain.copies.limit(0))
    for k, helped, index_ in ((3, True, plain), (50, False, R.open_index(spark, path))):
        monkeypatch.setattr(L, "_bounds_help", lambda *_: helped)
        want = sorted(map(tuple, R.search_bm25(everyone, q, "q", "text", k, pad=False).collect()))
        assert sorted(map(tuple, R.search_bm25(index_, q, "q", "text", k, pad=False).collect())) == want


def test_documents_alike_in_one_of_two_indexes(spark):
    """A rare word is no term of the word index but gives character n-grams."""
    rows = [(0, "mouse"), (1, "mouse xqzt"), (2, "mouse"), (3, "xqztu red"), (4, "red mouse")]
    docs, q = spark.createDataFrame(rows, "d long, text string"), queries(spark, "mouse xqzt")
    word, char = R.build_index(docs, "d", "text"), R.build_index(docs, "d", "text", "char")
    want = {}
    for index_, share in ((word, 0.6), (char, 0.4)):
        for r in R.search_tfidf(index_, q, "q", "text", 9, pad=False).collect():
            want[r["d"]] = want.get(r["d"], 0) + share * r["score"]
    got = {r["d"]: r["score"] for r in R.search_combined(word, char, q, "q", "text", 5).collect()}
    assert got == pytest.approx({d: want.get(d, 0.0) for d in range(5)}, abs=1e-8) and got[1] > got[0] == got[2]


def test_a_filter_on_vectors_does_not_encode_texts_again(spark):
    """Spark infers a filter from an explode of the vectors; it must not run the model below the model."""
    docs = spark.createDataFrame([(n, None if n == 3 else f"one word{n} two") for n in range(7)], "d long, text string").coalesce(1)

    def make():
        made = []

        def predict(texts):
            made.append(len(texts))
            return [[1.0, float(len(made)), float(len(texts))] for _ in texts]

        return predict

    encoded = R.encode_texts(docs, "text", "passage", make, 3, batch=2)
    cells = encoded.select("d", F.posexplode("embedding").alias("b", "x"))
    assert cells._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1
    rows = {r["d"]: r["embedding"] for r in encoded.collect()}
    calls = [round(v[1] / v[0]) for _, v in sorted(rows.items())]
    assert calls == [1, 1, 2, 2, 3, 3, 4] and [round(v[2] / v[0]) for _, v in sorted(rows.items())] == [2, 2, 2, 2, 2, 2, 1]


def test_blank_and_null_texts_do_not_stop_the_queries(spark, folder, tmp_path):
    """Documents without words: their vectors, lists and segments as in SQL."""
    import duckdb

    import __spark_entry__ as entry

    odd = [(10**6 + n, text, "en", "src0", 0) for n, text in enumerate(["", "  ", "\n\nx", None, "!!!\nsigns"])]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    (tmp_path / "benchmark.parquet").symlink_to(f"{folder}/benchmark.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    con.execute(f"create view benchmark as select * from '{folder}/benchmark.parquet'")
    for name in ("R8_text_encoding", "T16_query_segments_simple", "U3_shared_items"):
        got = entry.queries()[name](spark, str(tmp_path))
        want = con.execute(f"select {', '.join(got.columns)} from ({entry.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want)
    blank = spark.createDataFrame(odd[:1], docs.schema)
    with pytest.raises(Exception, match="blank text"):
        R.encode_texts(blank, "text", "passage", R.hashing_encoder(8), 8).collect()


def test_models_are_made_once_per_worker():
    from veriloom.functions.workers import KEPT, made_once

    made = []
    for key in "aab":
        assert made_once(f"once-{key}", lambda: made.append(key) or len(made)) == len(made)
    assert made == ["a", "b"]
    for n in range(KEPT):
        made_once(f"later-{n}", lambda: n)
    assert made_once("once-a", lambda: "again") == "again"


def test_dense_ties_and_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "d long, v array<float>")
    qs = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "q long, v array<float>")
    expected = {(7, 0, 1), (7, 1, 2), (7, 2, 3), (8, 2, 1), (8, 0, 2), (8, 1, 3)}
    assert {(r["q"], r["d"], r["rank"]) for r in R.search_dense(docs, "d", "v", qs, "q", "v", 3).collect()} == expected
    monkeypatch.setattr(R, "QUERY_BLOCK", 1)
    monkeypatch.setattr(R, "DOC_BLOCK", 1)
    assert {(r["q"], r["d"], r["rank"]) for r in R.search_dense(docs, "d", "v", qs, "q", "v", 3).collect()} == expected
    assert {(r["q"], r["d"], r["rank"]) for r in R.search_dense(docs, "d", "v", qs, "q", "v", 1).collect()} == {(7, 0, 1), (8, 2, 1)}
    assert R.search_dense(docs, "d", "v", qs.limit(0), "q", "v", 3).count() == 0 == R.search_dense(docs.limit(0), "d", "v", qs, "q", "v", 3).count()


def test_approximate_recall(spark):
    import random

    r = random.Random(2)

    def unit(center):
        v = [c + r.gauss(0, 0.6) / 4 for c in center]
        length = math.sqrt(sum(x * x for x in v))
        return [x / length for x in v]

    centers = [[r.gauss(0, 0.25) for _ in range(16)] for _ in range(8)]
    docs = spark.createDataFrame([(n, unit(centers[n % 8])) for n in range(400)], "d long, v array<double>")
    qs = spark.createDataFrame([(n, unit(centers[n])) for n in range(8)], "q long, v array<double>")
    exact = R.search_dense(docs, "d", "v", qs, "q", "v", 10)
    near = R.search_dense_approximate(docs, "d", "v", qs, "q", "v", 10)
    assert R.recall_of(near, exact, "q", "d").first()["recall"] >= 0.9


def test_retrieval_metrics_example(spark):
    ranked = spark.createDataFrame([("m", 1, "a", 1), ("m", 1, "b", 2), ("m", 1, "c", 3)], "method string, q long, d string, rank int")
    judged = spark.createDataFrame([(1, "a"), (1, "c"), (2, "z")], "q long, d string")
    rows = {r["q"]: r for r in M.retrieval_metrics(ranked, judged, ["method"], "q", "d").collect()}
    one = rows[1]
    assert (one["recall_1"], one["recall_5"], one["mrr"]) == (0.5, 1.0, 1.0)
    assert one["map_100"] == pytest.approx((1 + 2 / 3) / 2) and one["candidate_coverage"] == pytest.approx(0.03)
    assert rows[2]["zero_result_rate"] == 1.0 and rows[2]["recall_100"] == 0.0


def test_fusion_primitives(spark):
    lists = spark.createDataFrame(
        [("lexical", 1, "a", 2.0, 1), ("lexical", 1, "b", 1.0, 2), ("semantic", 1, "b", 0.9, 1), ("semantic", 1, "c", 0.5, 2), ("bm25", 1, "x", 9.0, 1)],
        "source string, q long, d string, score double, rank int",
    )
    rows = {r["d"]: r for r in U.align_lists(lists, "q", "d").collect()}
    assert set(rows) == {"a", "b", "c"}
    assert rows["a"]["lexical_scaled"] == 1.0 and rows["a"]["semantic_scaled"] == 0.0 and rows["a"]["bm25_scaled"] == 0.0
    order = {r["position"]: r["d"] for r in U.first_seen_union(lists, "q", "d", {"lexical": 0, "semantic": 1}).collect()}
    assert [order[i] for i in (1, 2, 3)] == ["a", "b", "c"]
    rrf = U.fuse(U.align_lists(lists, "q", "d"), "q", "d", alphas=[], rrf_ks=[60], union=False).where("rank = 1").first()
    assert rrf["d"] == "b" and rrf["score"] == pytest.approx(1 / 62 + 1 / 61, abs=1e-8)


def test_bootstrap_counts(spark):
    deltas = spark.createDataFrame([("m", 1, 1.0), ("m", 2, 0.0), ("m", 3, -0.5)], "method string, q long, delta double")
    r = ST.paired_bootstrap(deltas, "q", ["method"]).first()
    assert (r["improved"], r["unchanged"], r["worsened"]) == (1, 1, 1)
    assert r["ci_low"] <= r["delta"] <= r["ci_high"]


def test_ideal_order_has_full_gain(spark):
    df = spark.range(20).select(F.lit(1).alias("g"), F.col("id").alias("i"), (F.col("id") < 4).cast("int").alias("y"), (-F.col("id")).cast("double").alias("s"))
    r = M.group_ranking_metrics(df, "g", "i", "y", "s").first()
    assert r["ndcg_10"] == 1.0 and r["mrr"] == 1.0 and r["map_5"] == 1.0
    worse = M.group_ranking_metrics(df.withColumn("s", -F.col("s")), "g", "i", "y", "s").first()
    assert worse["ndcg_10"] < 1.0 and worse["mrr"] < 1.0

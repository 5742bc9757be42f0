"""Retrieval, fusion and retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import dot
from ..operators import fusion as U
from ..operators import metrics as M
from ..operators import retrieval as R
from ..operators import sampling as S
from ..operators import stats as ST
from ..operators.clean import pivot_delta
from ..session import scratch_path
from . import roles
from . import sql_text as Q
from .registry import query
from .text_queries import SEGMENT_CTES, SEGMENTS_DETAILED, detailed_segments

# Seeds, BM25 settings and metric names of the comparisons.
SEEDS = [42, 52, 62, 72, 82]
_COLS = ["term_id", "doc_id", "score", "rank"]


@query("R1_tfidf_search", f"WITH {Q.tfidf_ctes('t')}, h AS {Q.best('t_scores', 10)} SELECT * FROM h")
def _(t):
    index = roles.index(t, ngrams=2)
    return R.search_tfidf(index, roles.passages(t), "term_id", "query", 10, pad=False).select(*_COLS)


@query("R1_tfidf_search_chars", f"WITH {Q.tfidf_ctes('t', analyzer='char')}, h AS {Q.best('t_scores', 10)} SELECT * FROM h")
def _(t):
    index = roles.index(t, "char")
    return R.search_tfidf(index, roles.passages(t), "term_id", "query", 10, pad=False).select(*_COLS)


_PAD_QUERIES = "(SELECT item_id AS term_id FROM benchmark UNION ALL SELECT -1)"


@query(
    "R2_zero_score_padding",
    f"""WITH hits0 AS (SELECT b.item_id AS term_id, d.doc_id, 1::DOUBLE AS score FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
    h AS {Q.best('hits0', 10)} SELECT * FROM {Q.padded('h', 10, _PAD_QUERIES)}""",
)
def _(t):
    """Judged documents as hits: most passages have fewer than ten, one query has none."""
    scores = roles.judgments(t).select("term_id", F.col("item_id").alias("doc_id"), F.lit(1.0).alias("score"))
    queries = roles.passages(t).select("term_id").unionByName(t.spark.range(1).select(F.lit(-1).cast("long").alias("term_id")))
    hits = R.best(scores, ["term_id"], "doc_id", 10)
    return R.pad_with_zero(hits, queries, t.documents.select("doc_id"), "term_id", "doc_id", 10).select(*_COLS)


@query(
    "R3_combined_lexical",
    f"""WITH {Q.tfidf_ctes('w')}, {Q.tfidf_ctes('c', analyzer='char', with_queries=False)},
    s AS (SELECT term_id, doc_id, sum(x) AS score FROM (SELECT term_id, doc_id, 0.6::DOUBLE * score AS x FROM w_scores UNION ALL SELECT term_id, doc_id, 0.4::DOUBLE * score FROM c_scores) GROUP BY ALL),
    h AS {Q.best('s', 20)} SELECT term_id, doc_id, score, rank FROM {Q.padded('h', 20)}""",
)
def _(t):
    word = roles.index(t, ngrams=2)
    char = roles.index(t, "char")
    out = R.search_combined(word, char, roles.passages(t), "term_id", "query", 20)
    return out.select(*_COLS)


@query("R4_bm25_search", Q.every_term(f"WITH {Q.bm25_ctes(k=10)} SELECT * FROM {Q.padded('bm25_hits', 10)}"))
def _(t):
    index = roles.index(t)
    return R.search_bm25(index, roles.passages(t), "term_id", "query", 10).select(*_COLS)


_GRID = [(1.2, 0.75), (1.5, 0.75), (1.8, 0.6)]


def _grid_sql() -> str:
    base = Q.bm25_ctes(k=10)
    start = base[: base.index("bm25_scores AS")]
    scores = (
        f"g AS (SELECT * FROM (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE)' for a, b in _GRID)}) v(k1, b)), "
        f"gs AS (SELECT k1, b, term_id, dc.doc_id, round(sum(ln(1 + ({Q.N_DOCS} - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * (k1 + 1)) / "
        f"(tf + k1 * (1 - b + b * len / avgdl))), 9) AS score FROM dc JOIN dv USING (term) JOIN (SELECT term_id, term FROM qc) q USING (term) JOIN dl ON dl.doc_id = dc.doc_id, av, g GROUP BY k1, b, term_id, dc.doc_id)"
    )
    rank = "row_number() OVER (PARTITION BY k1, b, term_id ORDER BY score DESC, doc_id)"
    return f"WITH {start}{scores} SELECT k1, b, term_id, doc_id, score, {rank} AS rank FROM gs QUALIFY {rank} <= 10"


@query("R4_bm25_grid", Q.every_term(_grid_sql()))
def _(t):
    index = roles.index(t)
    return R.search_bm25_grid(index, roles.passages(t), "term_id", "query", _GRID, 10)


def _variant_sql(variant: str, text: str) -> str:
    return (
        f"p AS (SELECT p_partkey AS doc_id, {text} AS text FROM part), q AS (SELECT DISTINCT lower(p_type || ' ' || p_name) AS text FROM part), "
        f"queries AS (SELECT text AS term_id, text FROM q), {Q.counts_cte('dc', 'doc_id', 'text', 'p', 2)}, {Q.counts_cte('qc', 'term_id', 'text', 'queries', 2)}, "
        f"{Q.vocab_cte('v', 'dc')}, {Q.tfidf_cte('dw', 'doc_id', 'dc', 'v', '(SELECT count(*) FROM p)')}, {Q.tfidf_cte('qw', 'term_id', 'qc', 'v', '(SELECT count(*) FROM p)')}, "
        "s AS (SELECT q.term_id, d.doc_id, sum(d.weight * q.weight) AS score FROM dw d JOIN qw q ON d.term = q.term GROUP BY ALL), "
        f"h AS {Q.best('s', 5)}"
    )


@query(
    "R5_index_variants",
    "SELECT 'title_only' AS variant, * FROM (WITH "
    + _variant_sql("title_only", "p_name")
    + " SELECT * FROM h) UNION ALL SELECT 'enriched', * FROM (WITH "
    + _variant_sql("enriched", "p_name || ' ' || p_type || ' ' || p_brand")
    + " SELECT * FROM h)",
)
def _(t):
    text = F.lower(F.concat_ws(" ", "p_type", "p_name"))
    queries = t.part.select(text.alias("term_id"), text.alias("text")).distinct()
    out = None
    for variant, columns in (("title_only", ["p_name"]), ("enriched", ["p_name", "p_type", "p_brand"])):
        docs = t.part.select(F.col("p_partkey").alias("doc_id"), F.concat_ws(" ", *columns).alias("text"))
        index = R.build_index(docs, "doc_id", "text", ngrams=2)
        part = R.search_tfidf(index, queries, "term_id", "text", 5, pad=False).select(F.lit(variant).alias("variant"), *_COLS)
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "R6_index_statistics",
    Q.every_term(f"""WITH {Q.DOC_COUNTS}, {Q.vocab_cte('dv', 'dc')} SELECT count(*) AS postings, CAST(sum(tf) AS BIGINT) AS term_occurrences, (SELECT count(*) FROM dv) AS vocabulary,
    {Q.N_DOCS} AS documents, count(*) * 12 + ({Q.N_DOCS} + 1) * 4 AS index_bytes FROM dc WHERE term IN (SELECT term FROM dv)"""),
)
def _(t):
    return R.index_statistics(roles.index(t))


@query("R6_stored_index_search", Q.every_term(f"WITH {Q.bm25_ctes(k=10)} SELECT * FROM {Q.padded('bm25_hits', 10)}"))
def _(t):
    """An index written in two batches of documents and opened again answers like one built at once."""
    path, late = scratch_path(t.spark, "kept-index"), F.col("lang") == "en"
    first = R.write_index(t.documents.where(~F.coalesce(late, F.lit(False))), "doc_id", "text", path)
    R.append_documents(first, t.documents.where(late), "text")
    return R.search_bm25(R.open_index(t.spark, path), roles.passages(t), "term_id", "query", 10).select(*_COLS)


@query("R7_dense_recall")
def _(t):
    """Share of the exact best fifty that bucketed projections find, for every vector label."""
    centres = R.class_centroids(t.embeddings, "label", "embedding")
    exact = R.search_dense(t.embeddings, "vec_id", "embedding", centres, "label", "centroid", 50)
    near = R.search_dense_approximate(t.embeddings, "vec_id", "embedding", centres, "label", "centroid", 50)
    return R.recall_of(near, exact, "label", "vec_id")


@query(
    "R7_dense_search",
    """WITH m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) r(i) GROUP BY ALL),
    c AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM m),
    s AS (SELECT c.label, vec_id, round(sum(c.x * CAST(embedding[c.i] AS DOUBLE)), 9) AS score FROM c, embeddings GROUP BY ALL)
    SELECT label, vec_id, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) <= 50""",
)
def _(t):
    """Every vector against the mean vector of each label."""
    centres = R.class_centroids(t.embeddings, "label", "embedding")
    hits = R.search_dense(t.embeddings, "vec_id", "embedding", centres, "label", "centroid", 50)
    return hits.select("label", "vec_id", "score", "rank")


@query(
    "R7_dense_similarity",
    """WITH m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) r(i) GROUP BY ALL),
    c AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM m)
    SELECT vec_id, label, round(sum(c.x * CAST(embedding[c.i] AS DOUBLE)), 8) AS similarity FROM c JOIN embeddings USING (label) GROUP BY ALL""",
)
def _(t):
    centres = R.class_centroids(t.embeddings, "label", "embedding")
    joined = t.embeddings.join(centres, "label")
    return joined.select("vec_id", "label", F.round(dot("centroid", "embedding"), 8).alias("similarity"))


@query(
    "R8_text_encoding",
    f"""WITH {Q.dense_ctes(384)} SELECT doc_id, count(*) AS used_dimensions, round(sum(x * x), 5) AS squared_norm, round(sum(x * b), 3) AS moment FROM pv GROUP BY doc_id""",
)
def _(t):
    """Null texts have no vector; blank ones have that of the prefix."""
    texts = t.documents.where("text is not null").select("doc_id", "text")
    encoded = R.encode_texts(texts, "text", "passage", R.hashing_encoder(384), 384, allow_blank=True)
    cells = encoded.select("doc_id", F.posexplode("embedding").alias("b", "x")).where("x <> 0").withColumn("x", F.col("x").cast("double"))
    return cells.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("used_dimensions"), F.round(F.sum(F.col("x") * F.col("x")), 5).alias("squared_norm"), F.round(F.sum(F.col("x") * F.col("b")), 3).alias("moment")
    )


# --- fusion ----------------------------------------------------------------------------

ALIGNED = (
    Q.lists_ctes()
    + """, wide AS (SELECT term_id, doc_id, max(CASE WHEN source = 'lexical' THEN score END) AS ls, max(CASE WHEN source = 'semantic' THEN score END) AS ss,
      max(CASE WHEN source = 'bm25' THEN score END) AS bs, max(CASE WHEN source = 'lexical' THEN rank END) AS lr, max(CASE WHEN source = 'semantic' THEN rank END) AS sr
      FROM lists GROUP BY ALL HAVING max(CASE WHEN source <> 'bm25' THEN 1 ELSE 0 END) = 1),
    filled AS (SELECT term_id, doc_id, coalesce(ls, 0) AS ls, coalesce(ss, 0) AS ss, coalesce(bs, 0) AS bs, lr, sr FROM wide),
    b AS (SELECT term_id, min(ls) l0, max(ls) l1, min(ss) s0, max(ss) s1, min(bs) b0, max(bs) b1 FROM filled GROUP BY term_id),
    aligned AS (SELECT f.*, CASE WHEN l1 > l0 THEN (ls - l0) / (l1 - l0) ELSE 0 END AS l, CASE WHEN s1 > s0 THEN (ss - s0) / (s1 - s0) ELSE 0 END AS s,
      CASE WHEN b1 > b0 THEN (bs - b0) / (b1 - b0) ELSE 0 END AS b FROM filled f JOIN b USING (term_id))"""
)

FUSED = (
    ALIGNED
    + ", fs AS ("
    + " UNION ALL ".join(
        [f"SELECT 'weighted' AS method, {a}::DOUBLE AS parameter, term_id, doc_id, {a}::DOUBLE * l + {1 - a!r}::DOUBLE * s AS score FROM aligned" for a in U.ALPHAS]
        + [
            f"SELECT 'rrf', {k}::DOUBLE, term_id, doc_id, coalesce(1::DOUBLE / ({k} + lr), 0) + coalesce(1::DOUBLE / ({k} + sr), 0) FROM aligned"
            for k in U.RRF_KS
        ]
        + ["SELECT 'union', 0::DOUBLE, term_id, doc_id, 0.45::DOUBLE * l + 0.45::DOUBLE * s + 0.1::DOUBLE * b FROM aligned"]
    )
    + "), fr AS (SELECT method, parameter, term_id, doc_id, round(score, 9) AS score FROM fs), fused AS (SELECT *, row_number() OVER (PARTITION BY method, parameter, term_id ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS rank FROM fr "
    "QUALIFY row_number() OVER (PARTITION BY method, parameter, term_id ORDER BY score DESC, CAST(doc_id AS VARCHAR)) <= 100)"
)


def aligned(t):
    return U.align_lists(roles.retrieval_lists(t), "term_id", "doc_id")


def fused(t):
    return roles.stored(t, "fused", lambda: U.fuse(aligned(t), "term_id", "doc_id"))


@query("R9_minmax_normalisation", f"WITH {ALIGNED} SELECT term_id, doc_id, round(l, 7) AS lexical_scaled, round(s, 7) AS semantic_scaled, round(b, 7) AS bm25_scaled FROM aligned")
def _(t):
    return aligned(t).select("term_id", "doc_id", *[F.round(f"{s}_scaled", 7).alias(f"{s}_scaled") for s in ("lexical", "semantic", "bm25")])


@query("R10_weighted_fusion", f"WITH {FUSED} SELECT parameter AS alpha, term_id, doc_id, score, rank FROM fused WHERE method = 'weighted' AND rank <= 10")
def _(t):
    out = U.fuse(aligned(t), "term_id", "doc_id", 10, rrf_ks=[], union=False)
    return out.select(F.col("parameter").alias("alpha"), "term_id", "doc_id", "score", "rank")


@query("R11_reciprocal_rank_fusion", f"WITH {FUSED} SELECT parameter AS k, term_id, doc_id, score, rank FROM fused WHERE method = 'rrf' AND rank <= 10")
def _(t):
    out = U.fuse(aligned(t), "term_id", "doc_id", 10, alphas=[], union=False)
    return out.select(F.col("parameter").alias("k"), "term_id", "doc_id", "score", "rank")


@query("R12_candidate_union", f"WITH {FUSED} SELECT term_id, doc_id, score, rank FROM fused WHERE method = 'union' AND rank <= 10")
def _(t):
    out = U.fuse(aligned(t), "term_id", "doc_id", 10, alphas=[], rrf_ks=[])
    return out.select("term_id", "doc_id", "score", "rank")


@query("R13_fused_top_100", f"WITH {FUSED} SELECT method, parameter, term_id, doc_id, rank FROM fused")
def _(t):
    return fused(t).select("method", "parameter", "term_id", "doc_id", "rank")


# --- evaluation ------------------------------------------------------------------------

def metrics_ctes(source: str, keys: str) -> str:
    """``qm(keys, term_id, metrics…)`` of ranked lists in ``source``."""
    idcg = "list_sum(list_transform(range(1, least(total, 10) + 1), lambda i: 1 / log2(i + 1)))"
    ks = M.RETRIEVAL_KS
    hits = ", ".join(f"count(*) FILTER (rel = 1 AND rank <= {k}) AS h{k}" for k in ks)
    aps = ", ".join(f"coalesce(sum(CASE WHEN rel = 1 AND rank <= {k} THEN hits::DOUBLE / rank END), 0) AS ap{k}" for k in (10, 100))
    out = ", ".join(
        f"coalesce(h{k}, 0)::DOUBLE / greatest(total, 1) AS recall_{k}, CASE WHEN coalesce(h{k}, 0) > 0 THEN 1::DOUBLE ELSE 0 END AS hit_rate_{k}, "
        f"coalesce(coalesce(h{k}, 0)::DOUBLE / nullif(least({k}, coalesce(len, 0)), 0), 0) AS precision_{k}"
        for k in ks
    )
    return f"""tot AS (SELECT term_id, count(*) AS total FROM judgments GROUP BY 1),
    li AS (SELECT s.*, CASE WHEN j.item_id IS NULL THEN 0 ELSE 1 END AS rel FROM {source} s LEFT JOIN judgments j ON j.term_id = s.term_id AND j.item_id = s.doc_id),
    lh AS (SELECT *, sum(rel) OVER (PARTITION BY {keys}, term_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS hits FROM li),
    g AS (SELECT {keys}, term_id, count(*) AS len, min(CASE WHEN rel = 1 THEN rank END) AS first_hit, {hits}, {aps},
      coalesce(sum(CASE WHEN rel = 1 AND rank <= 10 THEN 1 / log2(rank + 1) END), 0) AS dcg FROM lh GROUP BY {keys}, term_id),
    ms AS (SELECT DISTINCT {keys} FROM {source}),
    qm AS (SELECT {', '.join('ms.' + k.strip() for k in keys.split(','))}, tot.term_id, {out}, coalesce(1::DOUBLE / first_hit, 0) AS mrr,
      coalesce(ap10, 0) / greatest(total, 1) AS map_10, coalesce(ap100, 0) / greatest(total, 1) AS map_100,
      coalesce(dcg, 0) / {idcg} AS ndcg_10, least(coalesce(len, 0)::DOUBLE / 100, 1) AS candidate_coverage,
      CASE WHEN coalesce(len, 0) = 0 THEN 1::DOUBLE ELSE 0 END AS zero_result_rate, 1::DOUBLE AS availability
      FROM tot CROSS JOIN ms LEFT JOIN g ON g.term_id = tot.term_id AND {' AND '.join(f'g.{k.strip()} = ms.{k.strip()}' for k in keys.split(','))})"""


METRIC_NAMES = [
    *[f"{m}_{k}" for k in M.RETRIEVAL_KS for m in ("recall", "hit_rate", "precision")],
    "mrr", "map_10", "map_100", "ndcg_10", "candidate_coverage", "zero_result_rate", "availability",
]

# every method under one name: the three retrievers and the fusion settings
METHODS_SQL = (
    FUSED
    + ", methods AS (SELECT source AS method, term_id, doc_id, rank FROM lists UNION ALL "
    "SELECT method || '_' || CAST(round(parameter * 100) AS INTEGER), term_id, doc_id, rank FROM fused)"
)
QUERY_METRICS_SQL = f"{METHODS_SQL}, {roles.JUDGMENTS}, {metrics_ctes('methods', 'method')}"


def method_lists(t):
    single = roles.retrieval_lists(t).select(F.col("source").alias("method"), "term_id", "doc_id", "rank")
    label = F.concat_ws("_", "method", F.round(F.col("parameter") * 100).cast("int"))
    return single.unionByName(fused(t).select(label.alias("method"), "term_id", "doc_id", "rank"))


def query_metrics(t):
    judged = roles.judgments(t).select("term_id", F.col("item_id").alias("doc_id"))
    return roles.stored(
        t, "query_metrics", lambda: M.retrieval_metrics(method_lists(t), judged, ["method"], "term_id", "doc_id")
    )


@query("E11_retrieval_metrics", f"WITH {QUERY_METRICS_SQL} SELECT method, term_id, {', '.join(f'round({m}, 6) AS {m}' for m in METRIC_NAMES)} FROM qm")
def _(t):
    return M.rounded(query_metrics(t).select("method", "term_id", *METRIC_NAMES), METRIC_NAMES)


SEED_SPLITS = f"""sd AS (SELECT unnest({SEEDS}) AS seed), tk AS (SELECT DISTINCT term_id FROM judgments),
    sk AS (SELECT seed, term_id, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || '|' || term_id), term_id) AS r, count(*) OVER (PARTITION BY seed) AS n FROM sd, tk),
    splits AS (SELECT seed, term_id, CASE WHEN r <= floor(0.3::DOUBLE * n) THEN 'train' WHEN r <= floor(0.6::DOUBLE * n) THEN 'validation' ELSE 'test' END AS split FROM sk),
    sm AS (SELECT seed, split, qm.* FROM qm JOIN splits USING (term_id))"""
SEED_METRICS_SQL = f"{QUERY_METRICS_SQL}, {SEED_SPLITS}"


def seed_metrics(t):
    splits = S.split_groups_by_seed(roles.judgments(t).select("term_id"), "term_id", SEEDS, (0.3, 0.6))
    return query_metrics(t).join(splits, "term_id")


_SHOWN = ["recall_10", "recall_50", "mrr", "ndcg_10"]


@query(
    "E12_mean_metrics",
    Q.every_term(f"WITH {SEED_METRICS_SQL} SELECT seed, method, {', '.join(f'round(avg({m}), 6) AS {m}' for m in _SHOWN)}, count(*) AS queries FROM sm WHERE split = 'test' GROUP BY ALL"),
)
def _(t):
    return M.rounded(M.mean_metrics(seed_metrics(t).where("split = 'test'"), ["seed", "method"], _SHOWN), _SHOWN)


_CHOSEN = "mm AS (SELECT seed, regexp_extract(method, '^(weighted|rrf)', 1) AS family, CAST(regexp_extract(method, '[0-9]+$') AS INTEGER) AS parameter, round(avg(recall_50), 9) AS mean_value FROM sm WHERE split = 'validation' AND regexp_matches(method, '^(weighted|rrf)_') GROUP BY ALL), chosen AS (SELECT * FROM mm QUALIFY row_number() OVER (PARTITION BY seed, family ORDER BY mean_value DESC, parameter) = 1)"


def _choices(t):
    rows = seed_metrics(t).where("split = 'validation'").where(F.regexp("method", F.lit("^(weighted|rrf)_")))
    rows = rows.withColumn("family", F.substring_index("method", "_", 1)).withColumn("parameter", F.substring_index("method", "_", -1).cast("int"))
    return U.choose_parameters(rows, "recall_50", ["seed", "family"])


@query("R14_parameter_choice", f"WITH {SEED_METRICS_SQL}, {_CHOSEN} SELECT seed, family, parameter, round(mean_value, 6) AS mean_value FROM chosen")
def _(t):
    return _choices(t).select("seed", "family", "parameter", F.round("mean_value", 6).alias("mean_value"))


@query("R15_deployed_parameter", f"WITH {SEED_METRICS_SQL}, {_CHOSEN} SELECT family, median(parameter) AS parameter FROM chosen GROUP BY family")
def _(t):
    return U.deployed_parameter(_choices(t), ["family"])


@query(
    "R16_batch_search",
    f"""WITH {SEED_METRICS_SQL}, {_CHOSEN}, dep AS (SELECT family, median(parameter) AS parameter FROM chosen GROUP BY family),
    f AS (SELECT x.method, x.parameter, x.term_id, x.doc_id, x.score, a.ls, a.ss, CASE WHEN a.lr IS NULL THEN 'semantic' WHEN a.sr IS NULL THEN 'lexical' ELSE 'both' END AS source
      FROM fused x JOIN aligned a USING (term_id, doc_id) JOIN dep ON dep.family = x.method AND dep.parameter = round(x.parameter * 100)),
    r AS (SELECT f.*, d.lang, row_number() OVER (PARTITION BY f.method, f.term_id ORDER BY f.score DESC, f.doc_id) AS rank FROM f JOIN documents d USING (doc_id) WHERE d.lang = 'en')
    SELECT method, parameter, term_id, doc_id, rank, score AS hybrid_score, ls AS lexical_score, ss AS semantic_score, source, lang FROM r WHERE rank <= 10""",
)
def _(t):
    """All passages at once with the deployed parameter of both methods, a language filter on the pool, ten results each."""
    chosen = U.deployed_parameter(_choices(t), ["family"]).select(F.col("family").alias("method"), "parameter")
    found = U.batch_search(fused(t), aligned(t), chosen, t.documents.select("doc_id", "lang"), "term_id", "doc_id", {"lang": "en"}, 10)
    return found.select(
        "method", "parameter", "term_id", "doc_id", "rank", F.col("score").alias("hybrid_score"), "lexical_score", "semantic_score", "source", "lang"
    )


@query(
    "C19_filtered_results",
    Q.every_term(f"""WITH {Q.bm25_ctes()} SELECT h.term_id, h.doc_id, h.score, lang, source, row_number() OVER (PARTITION BY h.term_id ORDER BY h.score DESC, h.doc_id) AS rank
    FROM bm25_hits h JOIN documents d USING (doc_id) WHERE lang = 'fr' AND source = 'src0' QUALIFY row_number() OVER (PARTITION BY h.term_id ORDER BY h.score DESC, h.doc_id) <= 20"""),
)
def _(t):
    pool = roles.bm25_lists(t).where("score > 0")
    return R.filter_results(pool, t.documents.select("doc_id", "lang", "source"), "term_id", "doc_id", {"lang": "fr", "source": "src0"}, 20)


@query(
    "R18_unchanged_check",
    f"WITH {QUERY_METRICS_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, count(*) AS compared, count(*) FILTER (term_id % 5 = 0 OR (term_id % 5 = 1 AND {m} IS NOT NULL) OR (term_id % 5 = 2 AND {m} IS NOT NULL)) AS changed FROM qm"
        for m in _SHOWN
    ),
)
def _(t):
    """A table against itself with rows missing, values nulled and values moved, by the passage's number."""
    q = query_metrics(t)
    kind = F.col("term_id") % 5
    old = q.where(kind != 0).withColumns({m: F.when(kind == 2, F.col(m) + 0.5).when(kind != 1, F.col(m)) for m in _SHOWN})
    return ST.unchanged_check(q, old, ["method", "term_id"], _SHOWN)


_EXAMPLES = """qd AS (SELECT term_id, max(CASE WHEN method = 'bm25' THEN recall_50 END) - max(CASE WHEN method = 'lexical' THEN recall_50 END) AS delta FROM qm GROUP BY term_id),
    ex AS (SELECT * FROM (SELECT * FROM qd ORDER BY delta, term_id LIMIT 8) UNION SELECT * FROM (SELECT * FROM qd ORDER BY delta DESC, term_id LIMIT 8))"""


def _examples(t):
    """The queries at both ends of the difference between two methods."""
    deltas = pivot_delta(query_metrics(t), ["term_id"], "method", "recall_50", "bm25", "lexical").select("term_id", "delta")
    return ST.extremes(deltas, "delta", ["term_id"], 8)


@query(
    "R19_query_examples",
    f"""WITH {QUERY_METRICS_SQL}, {_EXAMPLES},
    tt AS (SELECT l.source, l.term_id, string_agg(split_part(d.text, chr(10), 1), ' | ' ORDER BY rank) AS titles FROM lists l JOIN documents d USING (doc_id) WHERE rank <= 5 GROUP BY ALL)
    SELECT ex.term_id, tt.source AS method, round(delta, 6) AS delta, titles FROM ex JOIN tt USING (term_id)""",
)
def _(t):
    """Extreme queries with the best titles of every method."""
    chosen = _examples(t)
    docs = t.documents.select("doc_id", F.substring_index("text", "\n", 1).alias("title"))
    top = roles.retrieval_lists(t).where("rank <= 5").join(chosen, "term_id").join(docs, "doc_id")
    titles = F.array_sort(F.collect_list(F.struct("rank", "title")))  # five per query and method
    return top.groupBy("term_id", F.col("source").alias("method")).agg(
        F.round(F.max("delta"), 6).alias("delta"), F.array_join(F.transform(titles, lambda s: s["title"]), " | ").alias("titles")
    )


@query(
    "R19_missed_items",
    f"""WITH {QUERY_METRICS_SQL}, {_EXAMPLES}, ms3 AS (SELECT DISTINCT source FROM lists)
    SELECT ex.term_id, ms3.source AS method, j.item_id AS doc_id FROM ex JOIN judgments j USING (term_id) CROSS JOIN ms3
    WHERE NOT EXISTS (SELECT 1 FROM lists l WHERE l.source = ms3.source AND l.term_id = j.term_id AND l.doc_id = j.item_id)""",
)
def _(t):
    """Relevant documents that a method does not list for an extreme query, one row each."""
    judged = roles.judgments(t).select("term_id", F.col("item_id").alias("doc_id")).join(_examples(t).select("term_id"), "term_id", "left_semi")
    methods = F.explode(F.array(*[F.lit(m) for m in ("bm25", "lexical", "semantic")])).alias("method")
    listed = roles.retrieval_lists(t).select("term_id", "doc_id", F.col("source").alias("method"))
    return judged.select("*", methods).join(listed, ["term_id", "doc_id", "method"], "left_anti").select("term_id", "method", "doc_id")


# --- intervals over queries and seeds ---------------------------------------------------

_UNIT = "CAST('0x' || substr(md5({seed} || '|' || {b} || '|' || {i}), 1, 8) AS BIGINT)"


def _bootstrap_ctes(deltas: str, groups: list[str], seed: int = 42) -> str:
    """``boot(groups, ci)`` and ``cnt(groups, …)`` over ``deltas(groups, term_id, delta)``."""
    g = ", ".join(groups)
    draw = f"CAST('0x' || substr(sha256('{seed}|' || (b // {ST.LANES}) || '|' || term_id), 8 * (b % {ST.LANES}) + 1, 8) AS BIGINT)"
    weight = " + ".join(f"(x >= {cut})::INTEGER" for cut in ST.POISSON_CUTS)
    return f"""px AS (SELECT {g}, b, delta, {draw} AS x FROM {deltas}, range(0, 1000) r(b)),
    pw AS (SELECT {g}, b, delta, {weight} AS w FROM px),
    mn AS (SELECT {g}, b, sum(w * delta) / sum(w) AS m FROM pw GROUP BY ALL HAVING sum(w) > 0),
    boot AS (SELECT {g}, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM mn GROUP BY {g}),
    cnt AS (SELECT {g}, avg(delta) AS delta, count(*) FILTER (delta > 1e-12) AS improved, count(*) FILTER (abs(delta) <= 1e-12) AS unchanged, count(*) FILTER (delta < -1e-12) AS worsened FROM {deltas} GROUP BY {g}),
    bt AS (SELECT {g}, delta, lo AS ci_low, hi AS ci_high, improved, unchanged, worsened FROM cnt JOIN boot USING ({g}))"""


_DELTAS = "dt AS (SELECT c.method, c.term_id, c.ndcg_10 - b.ndcg_10 AS delta FROM qm c JOIN qm b ON b.term_id = c.term_id AND b.method = 'bm25' WHERE c.method <> 'bm25')"


@query("E13_paired_bootstrap", f"WITH {QUERY_METRICS_SQL}, {_DELTAS}, {_bootstrap_ctes('dt', ['method'])} SELECT method, round(delta, 6) AS delta, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, improved, unchanged, worsened FROM bt")
def _(t):
    q = query_metrics(t).select("method", "term_id", "ndcg_10")
    deltas = ST.paired_deltas(q.where("method <> 'bm25'"), q.where("method = 'bm25'"), ["term_id"], "ndcg_10", ["method"])
    return M.rounded(ST.paired_bootstrap(deltas, "term_id", ["method"]), ["delta", "ci_low", "ci_high"])


def _interval_sql(source: str, keys: list[str], metrics: list[str], extra: str = "") -> str:
    k = ", ".join(keys)
    cols = ", ".join(
        f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_std, round(avg({m}) - 2.776::DOUBLE * stddev_samp({m}) / sqrt(count({m})), 6) AS {m}_ci_low, round(avg({m}) + 2.776::DOUBLE * stddev_samp({m}) / sqrt(count({m})), 6) AS {m}_ci_high"
        for m in metrics
    )
    return f"SELECT {k}, count(DISTINCT seed) AS seeds, {extra}{cols} FROM {source} GROUP BY {k}"


_BY_SEED = f"bs AS (SELECT seed, method, {', '.join(f'avg({m}) AS {m}' for m in _SHOWN)} FROM sm WHERE split = 'test' GROUP BY ALL)"


def _by_seed(t):
    return M.mean_metrics(seed_metrics(t).where("split = 'test'"), ["seed", "method"], _SHOWN)


@query("E14_seed_intervals", Q.every_term(f"WITH {SEED_METRICS_SQL}, {_BY_SEED} {_interval_sql('bs', ['method'], _SHOWN)}"))
def _(t):
    return ST.seed_intervals(_by_seed(t), ["method"], _SHOWN)


_SEED_DELTAS = "sdt AS (" + " UNION ALL ".join(
    f"SELECT c.seed, c.method, '{m}' AS metric, c.term_id, c.{m} - b.{m} AS delta FROM sm c JOIN sm b ON b.term_id = c.term_id AND b.seed = c.seed AND b.method = 'bm25' WHERE c.method <> 'bm25' AND c.split = 'test'"
    for m in ("recall_50", "ndcg_10")
) + ")"
_PAIRED_SQL = f"{SEED_METRICS_SQL}, {_SEED_DELTAS}, {_bootstrap_ctes('sdt', ['seed', 'method', 'metric'])}"
_PAIRED_SUMS = "".join(f"CAST(sum({c}) AS BIGINT) AS {c}, " for c in ("improved", "unchanged", "worsened"))
_PAIRED_INTERVALS = _interval_sql("bt", ["method", "metric"], ["delta"], _PAIRED_SUMS)


def _paired_by_seed(t):
    def build():
        rows = seed_metrics(t).where("split = 'test'").select("seed", "method", "term_id", "recall_50", "ndcg_10")
        long = rows.unpivot(["seed", "method", "term_id"], ["recall_50", "ndcg_10"], "metric", "v")
        deltas = ST.paired_deltas(
            long.where("method <> 'bm25'"), long.where("method = 'bm25'"), ["seed", "term_id", "metric"], "v", ["method"]
        )
        return ST.paired_bootstrap(deltas, "term_id", ["seed", "method", "metric"])

    return roles.stored(t, "paired_by_seed", build)


def _paired_intervals(t):
    return ST.seed_intervals(_paired_by_seed(t), ["method", "metric"], ["delta"], sums=["improved", "unchanged", "worsened"])


@query("E15_paired_deltas_over_seeds", f"WITH {_PAIRED_SQL} {_PAIRED_INTERVALS}")
def _(t):
    return _paired_intervals(t)


@query(
    "E16_segment_metrics",
    f"""WITH {METHODS_SQL}, {SEGMENT_CTES}, {metrics_ctes('methods', 'method')}, seg AS ({SEGMENTS_DETAILED})
    SELECT segment, method, round(avg(recall_50), 6) AS recall_50_mean, count(recall_50) AS recall_50_count, round(avg(ndcg_10), 6) AS ndcg_10_mean, count(ndcg_10) AS ndcg_10_count
    FROM seg JOIN qm USING (term_id) GROUP BY ALL""",
)
def _(t):
    joined = detailed_segments(t).join(query_metrics(t), "term_id")
    out = joined.groupBy("segment", "method").agg(
        *[x for m in ("recall_50", "ndcg_10") for x in (F.round(F.avg(m), 6).alias(f"{m}_mean"), F.count(m).alias(f"{m}_count"))]
    )
    return out


_BOARD = "row_number() OVER (ORDER BY ndcg_10 DESC, recall_50 DESC, method)"


@query(
    "E21_leaderboard",
    Q.every_term(f"WITH {QUERY_METRICS_SQL}, a AS (SELECT method, round(avg(ndcg_10), 9) AS ndcg_10, round(avg(recall_50), 9) AS recall_50 FROM qm GROUP BY 1) SELECT method, ndcg_10, recall_50, {_BOARD} AS position FROM a"),
)
def _(t):
    means = M.rounded(M.mean_metrics(query_metrics(t), ["method"], ["ndcg_10", "recall_50"]).drop("queries"), ["ndcg_10", "recall_50"], 9)
    return ST.leaderboard(means, [], [F.desc("ndcg_10"), F.desc("recall_50"), F.asc("method")])


@query(
    "E22_promotion_decision",
    f"WITH {_PAIRED_SQL}, iv AS ({_PAIRED_INTERVALS}) SELECT method, metric, delta_mean, delta_ci_low, CASE WHEN delta_ci_low > 0 THEN 'promote' ELSE 'retain' END AS decision FROM iv",
)
def _(t):
    return ST.promotion_decision(_paired_intervals(t), "delta_ci_low").select("method", "metric", "delta_mean", "delta_ci_low", "decision")


@query(
    "C20_pivot_delta",
    Q.every_term(f"WITH {SEED_METRICS_SQL} SELECT seed, term_id, max(CASE WHEN method = 'lexical' THEN recall_50 END) AS lexical, max(CASE WHEN method = 'bm25' THEN recall_50 END) AS bm25, "
    "max(CASE WHEN method = 'bm25' THEN recall_50 END) - max(CASE WHEN method = 'lexical' THEN recall_50 END) AS delta FROM sm GROUP BY seed, term_id"),
)
def _(t):
    return pivot_delta(seed_metrics(t), ["seed", "term_id"], "method", "recall_50", "bm25", "lexical")


# --- set operations over rankings -------------------------------------------------------


@query(
    "U2_first_seen_union",
    f"""WITH {Q.lists_ctes()}, f AS (SELECT term_id, doc_id, min(CASE source WHEN 'lexical' THEN 0 ELSE 1000 END + rank) AS p FROM lists WHERE source <> 'bm25' GROUP BY ALL)
    SELECT term_id, doc_id, row_number() OVER (PARTITION BY term_id ORDER BY p) AS position FROM f""",
)
def _(t):
    return U.first_seen_union(roles.retrieval_lists(t), "term_id", "doc_id", {"lexical": 0, "semantic": 1})


@query(
    "U3_shared_items",
    f"WITH {Q.lists_ctes()}, c AS (SELECT term_id, doc_id, count(DISTINCT source) AS n FROM lists GROUP BY ALL) SELECT source, term_id, doc_id, n > 1 AS is_shared FROM lists JOIN c USING (term_id, doc_id)",
)
def _(t):
    lists = roles.retrieval_lists(t)
    seen = lists.groupBy("term_id", "doc_id").agg(F.count_distinct("source").alias("n"))
    return lists.join(seen, ["term_id", "doc_id"]).select("source", "term_id", "doc_id", (F.col("n") > 1).alias("is_shared"))


@query(
    "J5_missed_relevant_ids",
    Q.every_term(f"WITH {Q.bm25_ctes(k=1)}, {roles.JUDGMENTS} SELECT term_id, item_id FROM judgments j WHERE NOT EXISTS (SELECT 1 FROM {Q.padded('bm25_hits', 1)} h WHERE h.term_id = j.term_id AND h.doc_id = j.item_id)"),
)
def _(t):
    top = roles.bm25_lists(t).where("rank <= 1").select("term_id", F.col("doc_id").alias("item_id"))
    return roles.judgments(t).join(top, ["term_id", "item_id"], "left_anti").select("term_id", "item_id")


@query(
    "J6_query_catalogue_pairs",
    f"WITH {Q.QUERIES}, {Q.counts_cte('qc', 'term_id', 'text', 'queries')}, {Q.DOC_COUNTS} SELECT term_id, doc_id, count(*) AS shared_terms FROM qc JOIN dc USING (term) GROUP BY ALL",
)
def _(t):
    """Pairs of passages and documents found through shared words, never by a product."""
    from ..operators.features import term_counts

    q = term_counts(roles.passages(t), "term_id", "query").select("term_id", "term")
    d = term_counts(t.documents, "doc_id", "text").select("doc_id", "term")
    return d.join(q, "term").groupBy("doc_id", "term_id").agg(F.count(F.lit(1)).alias("shared_terms"))


@query("A5_first_query_text", "SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id")
def _(t):
    return t.conversations.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))


@query(
    "A4_ordered_ids",
    f"WITH {roles.JUDGMENTS} SELECT term_id, count(*) AS positives, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS relevant_ids FROM judgments GROUP BY term_id",
)
def _(t):
    ids = F.array_sort(F.collect_list(F.when(F.col("relevance_label") == 1, F.col("item_id")))).cast("array<string>")
    return roles.judgments(t).groupBy("term_id").agg(
        F.count(F.lit(1)).alias("positives"), F.array_join(ids, ",").alias("relevant_ids")
    )


@query("T2_search_text_full")
def _(t):
    return t.pages.select("page_id", T.normalize_search("html").alias("norm"))

"""Text normalisation and text features."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import features as X
from . import roles
from . import sql_text as Q
from .registry import query


@query("T1_normalize_basic", f"SELECT doc_id, {Q.normalize_basic('text')} AS norm FROM documents")
def _(t):
    return t.documents.select("doc_id", T.normalize_basic("text").alias("norm"))


@query("T2_normalize_search_builtin", f"SELECT page_id, {Q.normalize_search('html', squeeze=False)} AS norm FROM pages")
def _(t):
    return t.pages.select("page_id", T.normalize_search("html", fold=False, squeeze=False).alias("norm"))


@query("T2_normalize_search", f"SELECT doc_id, {Q.normalize_search('text')} AS norm FROM documents")
def _(t):
    return t.documents.select("doc_id", T.normalize_search("text").alias("norm"))


_FIELDS = {"title": "title", "category": "category", "brand": "brand", "attributes": "attributes"}


@query(
    "T3_searchable_text",
    f"""WITH {roles.CATALOGUE}, n AS (SELECT item_id, {Q.normalize_search('title')} AS ti, {Q.normalize_search('category')} AS ca,
      {Q.normalize_search('brand')} AS br, {Q.normalize_search('attributes')} AS att FROM catalogue)
    SELECT item_id, ti AS title_only, concat_ws(' ', nullif(ti, ''), nullif(ti, ''), nullif(ca, ''), nullif(br, ''), nullif(att, '')) AS enriched FROM n""",
)
def _(t):
    cat = roles.catalogue(t)
    return cat.select(
        "item_id",
        X.searchable_text(cat, _FIELDS, "title_only").alias("title_only"),
        X.searchable_text(cat, _FIELDS, weights={"title": 2}).alias("enriched"),
    )


@query(
    "T4_pair_documents",
    f"""WITH {roles.pairs_ctes()}, n AS (SELECT term_id, doc_id, {Q.normalize_basic('query')} AS q, {Q.normalize_basic('title')} AS ti, {Q.normalize_basic('category')} AS ca,
      {Q.normalize_basic('brand')} AS br, {Q.normalize_basic('attributes')} AS att FROM pairs),
    p AS (SELECT *, regexp_replace(concat_ws(' ', ti, ca, br, att), '^\\s+|\\s+$', '', 'g') AS doc FROM n)
    SELECT term_id, doc_id, md5(doc) AS product_md5, md5(regexp_replace(concat_ws(' ', q, '[ürün]', doc), '^\\s+|\\s+$', '', 'g')) AS pair_md5 FROM p""",
)
def _(t):
    product = X.product_document("title", "category", "brand", "attributes")
    return roles.pairs(t).select(
        "term_id", "doc_id", F.md5(product).alias("product_md5"), F.md5(X.pair_document("query", product)).alias("pair_md5")
    )


@query(
    "T5_review_cleaning",
    r"""SELECT page_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(html || ' ' || url, '<[^>]+>', ' ', 'g'), 'https?://\S+|www\.\S+', ' URL ', 'g'), '\s+', ' ', 'g'))) AS cleaned
    FROM pages""",
)
def _(t):
    return t.pages.select("page_id", T.clean_review(F.concat_ws(" ", "html", "url")).alias("cleaned"))


@query("T6_collapsed_catalogue", r"SELECT p_partkey, trim(regexp_replace('  ' || p_name || '   ' || p_type, '\s+', ' ', 'g')) AS title FROM part")
def _(t):
    return t.part.select("p_partkey", T.collapse(F.concat(F.lit("  "), "p_name", F.lit("   "), "p_type")).alias("title"))


@query(
    "T7_word_ngrams",
    f"WITH {Q.counts_cte('c', 'doc_id', 'text', 'documents', 2)} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM c GROUP BY term",
)
def _(t):
    counts = X.term_counts(t.documents, "doc_id", "text", ngrams=2)
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query("T8_char_ngrams", f"WITH {Q.counts_cte('c', 'item_id', 'text', 'benchmark', analyzer='char')} SELECT item_id, term, tf FROM c")
def _(t):
    return X.term_counts(t.benchmark, "item_id", "text", analyzer="char").select("item_id", "term", "tf")


@query(
    "T9_vocabulary",
    f"""WITH {Q.counts_cte('c', 'doc_id', 'text', 'documents', 2)}, v AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM c GROUP BY term
      HAVING count(*) >= 2 AND count(*) <= 0.98::DOUBLE * (SELECT count(*) FROM documents))
    SELECT term, df, cf FROM v QUALIFY row_number() OVER (ORDER BY cf DESC, term) <= 5000""",
)
def _(t):
    n = t.documents.agg(F.count(F.lit(1))).scalar()
    return X.vocabulary(X.term_counts(t.documents, "doc_id", "text", ngrams=2), 2, 5000, n * 0.98)


@query(
    "T10_tfidf",
    f"""WITH {Q.counts_cte('c', 'doc_id', 'text', 'documents')}, {Q.vocab_cte('v', 'c')}, {Q.tfidf_cte('w', 'doc_id', 'c', 'v', Q.N_DOCS)}
    SELECT doc_id, term, tf, round(weight, 7) AS weight FROM w""",
)
def _(t):
    counts = X.term_counts(t.documents, "doc_id", "text")
    n = t.documents.agg(F.count(F.lit(1))).scalar()
    out = X.tfidf(counts, "doc_id", X.vocabulary(counts), n)
    return out.select("doc_id", "term", "tf", F.round("weight", 7).alias("weight"))


def pair_features_ctes() -> str:
    nb, w = Q.normalize_basic, Q.words
    return f"""{roles.pairs_ctes()}, nrm AS (SELECT term_id, doc_id, label, bm25, {nb('query')} AS q, {nb('title')} AS ti, {nb('brand')} AS br, {nb('category')} AS ca, {nb('attributes')} AS att FROM pairs),
    s AS (SELECT *, list_distinct({w('q')}) AS qs, list_distinct({w('ti')}) AS ts, list_distinct({w('ca')}) AS cs, list_distinct({w('att')}) AS ats FROM nrm),
    z AS (SELECT *, len(qs) AS qn, len(ts) AS tn, len(list_intersect(qs, ts)) AS inter, len(list_distinct(list_concat(qs, ts))) AS uni FROM s),
    feats AS (SELECT term_id, doc_id, label, bm25,
      CASE WHEN q = ti AND q <> '' THEN 1 ELSE 0 END AS exact_match, CASE WHEN q <> '' AND contains(ti, q) THEN 1 ELSE 0 END AS query_in_title,
      CASE WHEN ti <> '' AND contains(q, ti) THEN 1 ELSE 0 END AS title_in_query, CAST(qn AS INTEGER) AS query_words, CAST(tn AS INTEGER) AS title_words,
      CAST(abs(qn - tn) AS INTEGER) AS length_difference, CAST(inter AS INTEGER) AS intersection, CAST(uni AS INTEGER) AS "union",
      CASE WHEN uni > 0 THEN inter::DOUBLE / uni ELSE 0 END AS jaccard, CASE WHEN qn > 0 THEN inter::DOUBLE / qn ELSE 0 END AS query_coverage,
      CASE WHEN tn > 0 THEN inter::DOUBLE / tn ELSE 0 END AS title_coverage, CASE WHEN br <> '' AND contains(q, br) THEN 1 ELSE 0 END AS brand_mention,
      CAST(len(list_intersect(qs, cs)) AS INTEGER) AS category_overlap,
      CASE WHEN q <> '' AND ti <> '' THEN least(length(q), length(ti))::DOUBLE / greatest(length(q), length(ti)) ELSE 0 END AS char_length_ratio,
      CAST(len(list_intersect(qs, ats)) AS INTEGER) AS attributes_overlap FROM z)"""


_FEATURE_LIST = ", ".join(f'"{c}"' for c in X.PAIR_FEATURES)


def featured_pairs(t):
    return X.pair_features(roles.pairs(t), "query", "title", "category", "brand", "attributes")


@query("T11_pair_features", f"WITH {pair_features_ctes()} SELECT term_id, doc_id, {_FEATURE_LIST} FROM feats")
def _(t):
    return featured_pairs(t).select("term_id", "doc_id", *X.PAIR_FEATURES)


def _pair_cosine_sql(analyzer: str) -> str:
    return f"""WITH {roles.pairs_ctes()}, pt AS (SELECT term_id || '-' || doc_id AS pair, query, title FROM pairs),
    st AS (SELECT pair || '|l' AS d, query AS text FROM pt UNION ALL SELECT pair || '|r', title FROM pt),
    {Q.counts_cte('c', 'd', 'text', 'st', 2, analyzer)}, {Q.vocab_cte('v', 'c')}, {Q.tfidf_cte('w', 'd', 'c', 'v', '(SELECT count(*) FROM st)')},
    x AS (SELECT split_part(a.d, '|', 1) AS pair, sum(a.weight * b.weight) AS s FROM w a JOIN w b ON a.term = b.term AND a.d = split_part(a.d, '|', 1) || '|l' AND b.d = split_part(a.d, '|', 1) || '|r' GROUP BY 1)
    SELECT pt.pair, round(coalesce(s, 0), 7) AS cosine FROM pt LEFT JOIN x ON x.pair = pt.pair"""


def _pair_cosine(t, analyzer: str):
    p = roles.pairs(t).select(F.concat_ws("-", "term_id", "doc_id").alias("pair"), "query", "title")
    return X.pair_cosine(p, "pair", "query", "title", analyzer).select("pair", F.round("cosine", 7).alias("cosine"))


@query("T12_pair_cosine_words", _pair_cosine_sql("word"))
def _(t):
    return _pair_cosine(t, "word")


@query("T12_pair_cosine_chars", _pair_cosine_sql("char"))
def _(t):
    return _pair_cosine(t, "char")


@query(
    "T13_frequency_encoding",
    """WITH k AS (SELECT p_partkey, p_type, row_number() OVER (ORDER BY md5('42|' || p_partkey), p_partkey) AS r, count(*) OVER () AS n FROM part),
    tr AS (SELECT p_type FROM k WHERE r <= floor(0.8::DOUBLE * n) AND p_type <> 'PROMO'), c AS (SELECT p_type, count(*) AS n FROM tr GROUP BY 1),
    co AS (SELECT p_type, n::DOUBLE / (SELECT count(*) FROM tr) AS share, row_number() OVER (ORDER BY n DESC, p_type) AS code FROM c)
    SELECT p_partkey, part.p_type, coalesce(share, 0) AS p_type_frequency, coalesce(code, 0) AS p_type_code, 0 AS p_type_missing FROM part LEFT JOIN co ON part.p_type = co.p_type""",
)
def _(t):
    from ..operators.sampling import split_rows

    parts = t.part.select("p_partkey", "p_type")
    train = split_rows(parts, ["p_partkey"], (0.8,), ("train", "test")).where("split = 'train' and p_type <> 'PROMO'")
    return X.encode_frequency(parts, "p_type", X.frequency_codes(train, "p_type"))


_FEATURE_ARRAY = ", ".join(f'CAST("{c}" AS DOUBLE)' for c in X.PAIR_FEATURES)


@query("T14_feature_assembly", f"WITH {pair_features_ctes()} SELECT term_id, doc_id, [{_FEATURE_ARRAY}] AS features FROM feats")
def _(t):
    out = VectorAssembler(inputCols=X.PAIR_FEATURES, outputCol="features").transform(featured_pairs(t))
    return out.select("term_id", "doc_id", vector_to_array("features").alias("features"))


@query(
    "T15_query_token_frequency",
    f"""WITH t AS (SELECT item_id, unnest(list_distinct({Q.words(Q.normalize_search('text'))})) AS token FROM benchmark)
    SELECT token, count(*) AS n_texts, count(*) <= 2 AS is_rare FROM t GROUP BY token""",
)
def _(t):
    q = t.benchmark.select("item_id", T.normalize_search("text").alias("text"))
    return X.token_document_frequency(q, "item_id", "text")


# Fixed dictionaries would never meet invented prose, so both come from the documents:
# the sources act as brands and the words of first lines as categories.


def segment_inputs(t):
    q = roles.passages(t).select("term_id", T.normalize_search("query").alias("text"))
    title = T.normalize_search(F.substring_index("text", "\n", 1))
    brands = t.documents.select(T.normalize_search("source").alias("brand"))
    last = t.documents.select(F.try_element_at(T.words(title), F.lit(-1)).alias("word")).where("word is not null")
    every = t.documents.select(F.explode(T.words(title)).alias("word"))
    docs = t.documents.select(F.col("doc_id").alias("item_id"), T.normalize_search("text").alias("doc"))
    relevant = roles.judgments(t).select("term_id", "item_id").join(docs, "item_id").select("term_id", "doc")
    return q, brands, last, every, X.relevant_overlap(q, "term_id", "text", relevant, "doc")


def _segment_ctes() -> str:
    title = Q.normalize_search("split_part(text, chr(10), 1)")
    return f"""{roles.JUDGMENTS}, sq AS (SELECT item_id AS term_id, {Q.words(Q.normalize_search('text'))} AS w FROM benchmark),
    tc AS (SELECT token, count(*) AS c FROM (SELECT unnest(list_distinct(w)) AS token FROM sq) GROUP BY 1),
    ut AS (SELECT DISTINCT term_id, unnest(w) AS token FROM sq),
    br AS (SELECT DISTINCT {Q.normalize_search('source')} AS token FROM documents),
    tl AS (SELECT {Q.words(title)} AS l FROM documents),
    cl AS (SELECT DISTINCT l[-1] AS token FROM tl WHERE len(l) > 0), ca AS (SELECT DISTINCT unnest(l) AS token FROM tl),
    rel AS (SELECT DISTINCT j.term_id, unnest({Q.words(Q.normalize_search('d.text'))}) AS token FROM judgments j JOIN documents d ON d.doc_id = j.item_id),
    ov AS (SELECT sq.term_id, (SELECT count(*) FROM ut JOIN rel ON rel.term_id = ut.term_id AND rel.token = ut.token WHERE ut.term_id = sq.term_id)::DOUBLE / greatest(len(list_distinct(w)), 1) AS o FROM sq)"""


_LENGTH = "SELECT term_id, CASE WHEN len(w) <= 2 THEN 'short_query' WHEN len(w) >= 4 THEN 'long_query' ELSE 'medium_query' END AS segment FROM sq"


def _word_segment(name: str, source: str) -> str:
    return f"SELECT DISTINCT term_id, '{name}' FROM ut WHERE token IN (SELECT token FROM {source})"


def _list_segment(name: str, values: list[str]) -> str:
    return f"SELECT DISTINCT term_id, '{name}' FROM ut WHERE token IN ({', '.join(repr(v) for v in values)})"


_COMMON = [_LENGTH, _word_segment("brand_query", "br"), _list_segment("gender_specific", X.GENDER_WORDS), _list_segment("age_specific", X.AGE_WORDS)]
SEGMENTS_SIMPLE = " UNION ALL ".join(
    _COMMON
    + [
        _word_segment("category_query", "cl"),
        r"SELECT DISTINCT term_id, 'number_or_model_code' FROM ut WHERE regexp_matches(token, '\p{Nd}')",
        "SELECT DISTINCT term_id, 'rare_token' FROM ut JOIN tc USING (token) WHERE c <= 2",
    ]
)
SEGMENTS_DETAILED = " UNION ALL ".join(
    _COMMON
    + [
        _word_segment("category_query", "ca"),
        r"SELECT DISTINCT term_id, unnest(['number_heavy_query', 'model_code_query']) FROM ut WHERE regexp_matches(token, '\p{Nd}')",
        "SELECT DISTINCT term_id, 'unit_query' FROM ut WHERE regexp_matches(token, '[0-9]+(ml|l|kg|gr|g|cm|mm|gb|tb|w|mah)$')",
        "SELECT term_id, 'attribute_heavy_query' FROM sq WHERE len(w) >= 5",
        "SELECT DISTINCT term_id, 'rare_token_query' FROM ut JOIN tc USING (token) WHERE c <= 2",
        "SELECT term_id, CASE WHEN o <= 0.25 THEN 'low_lexical_overlap' WHEN o >= 0.75 THEN 'high_lexical_overlap' ELSE 'medium_lexical_overlap' END FROM ov",
    ]
)


@query("T16_query_segments_simple", f"WITH {_segment_ctes()} {SEGMENTS_SIMPLE}")
def _(t):
    q, brands, last, _every, _overlap = segment_inputs(t)
    return X.query_segments(q, "term_id", "text", brands, last, detailed=False)


@query("T16_query_segments_detailed", f"WITH {_segment_ctes()} {SEGMENTS_DETAILED}")
def _(t):
    q, brands, _last, every, overlap = segment_inputs(t)
    return X.query_segments(q, "term_id", "text", brands, every, overlap)


def detailed_segments(t):
    q, brands, _last, every, overlap = segment_inputs(t)
    return X.query_segments(q, "term_id", "text", brands, every, overlap)


SEGMENT_CTES = _segment_ctes()


@query(
    "T17_overlap_signal",
    f"WITH {roles.pairs_ctes()} SELECT term_id, doc_id, CAST(len(list_intersect(list_distinct({Q.words('lower(query)')}), list_distinct({Q.words('lower(title)')}))) AS INTEGER) AS shared_tokens FROM pairs",
)
def _(t):
    from ..operators.retrieval import overlap_signal

    return overlap_signal(roles.pairs(t), "query", "title").select("term_id", "doc_id", "shared_tokens")

"""SQL building blocks for the text and retrieval oracles."""

from __future__ import annotations

import re

WORD = r"[\p{L}\p{N}_]"


def tokens(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '{WORD}{{2,}}')"


def words(c: str) -> str:
    return rf"list_filter(regexp_split_to_array({c}, '\s+'), lambda w: w <> '')"


def char_grams_cte(name: str, key: str, text: str, source: str) -> str:
    """``name(key, term, tf)`` of padded character 3- to 5-grams."""
    return (
        f"{name}_w AS (SELECT {key}, ' ' || unnest({words(f'lower({text})')}) || ' ' AS w FROM {source}), "
        f"{name}_n AS (SELECT {key}, w, unnest([3, 4, 5]) AS n FROM {name}_w), "
        f"{name}_g AS (SELECT {key}, substr(w, unnest(range(1, length(w) - n + 2)), n) AS term FROM {name}_n WHERE n <= length(w)), "
        f"{name} AS (SELECT {key}, term, count(*) AS tf FROM {name}_g GROUP BY ALL)"
    )


def counts_cte(name: str, key: str, text: str, source: str, ngrams: int = 1, analyzer: str = "word") -> str:
    if analyzer == "char":
        return char_grams_cte(name, key, text, source)
    return (
        f"{name}_l AS (SELECT {key}, {tokens(text)} AS l FROM {source}), "
        + (
            f"{name}_t AS (SELECT {key}, unnest(l) AS term FROM {name}_l), "
            if ngrams == 1
            else f"{name}_t AS (SELECT {key}, unnest(list_concat(l, list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1]))) AS term FROM {name}_l), "
        )
        + f"{name} AS (SELECT {key}, term, count(*) AS tf FROM {name}_t GROUP BY ALL)"
    )


def vocab_cte(name: str, counts: str, cap: int = 120000) -> str:
    return (
        f"{name} AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM {counts} GROUP BY term HAVING count(*) >= 2 "
        f"QUALIFY row_number() OVER (ORDER BY sum(tf) DESC, term) <= {cap})"
    )


def every_term(sql: str) -> str:
    """``sql`` over the whole vocabulary, as the indexes keep it: the cap of ``vocab_cte`` fits small tables only."""
    return re.sub(r" QUALIFY row_number\(\) OVER \(ORDER BY sum\(tf\) DESC, term\) <= \d+\)", ")", sql)


def tfidf_cte(name: str, key: str, counts: str, vocab: str, n_docs: str) -> str:
    return (
        f"{name}_r AS (SELECT {key}, c.term, tf, (1 + ln(tf)) * (ln((1 + {n_docs})::DOUBLE / (1 + df)) + 1) AS w FROM {counts} c JOIN {vocab} v ON c.term = v.term), "
        f"{name} AS (SELECT {key}, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight FROM {name}_r)"
    )


def best(scores: str, k: int, positive: bool = True) -> str:
    """Ranked top ``k`` of ``scores(term_id, doc_id, score)``, scores rounded first."""
    return (
        f"(SELECT term_id, doc_id, score, row_number() OVER (PARTITION BY term_id ORDER BY score DESC, doc_id) AS rank "
        f"FROM (SELECT term_id, doc_id, round(score, 9) AS score FROM {scores}) WHERE {'score > 0' if positive else 'true'} "
        f"QUALIFY row_number() OVER (PARTITION BY term_id ORDER BY score DESC, doc_id) <= {k})"
    )


def padded(hits: str, k: int, queries: str = "(SELECT item_id AS term_id FROM benchmark)", docs: str = "documents") -> str:
    """Fill short lists of ``hits(term_id, doc_id, score, rank)`` with the smallest free ids."""
    return (
        f"(SELECT term_id, doc_id, score, row_number() OVER (PARTITION BY term_id ORDER BY score DESC, doc_id) AS rank FROM ("
        f"SELECT term_id, doc_id, score FROM {hits} UNION ALL "
        f"SELECT q.term_id, f.doc_id, CAST(0 AS DOUBLE) FROM {queries} q, (SELECT doc_id FROM {docs} ORDER BY doc_id LIMIT {k}) f "
        f"WHERE NOT EXISTS (SELECT 1 FROM {hits} h WHERE h.term_id = q.term_id AND h.doc_id = f.doc_id)) "
        f"QUALIFY row_number() OVER (PARTITION BY term_id ORDER BY score DESC, doc_id) <= {k})"
    )


QUERIES = "queries AS (SELECT item_id AS term_id, text FROM benchmark)"
DOC_COUNTS = counts_cte("dc", "doc_id", "text", "documents")
QUERY_COUNTS = counts_cte("qc", "term_id", "text", "queries")
N_DOCS = "(SELECT count(*) FROM documents)"


def bm25_ctes(k1: float = 1.5, b: float = 0.75, k: int = 100) -> str:
    """``bm25_hits(term_id, doc_id, score, rank)`` over whole documents and passages."""
    return (
        f"{QUERIES}, {DOC_COUNTS}, {QUERY_COUNTS}, {vocab_cte('dv', 'dc')}, "
        f"dl AS (SELECT doc_id, sum(tf) AS len FROM dc JOIN dv USING (term) GROUP BY doc_id), "
        f"av AS (SELECT greatest(sum(cf)::DOUBLE / {N_DOCS}, 1) AS avgdl FROM dv), "
        f"bm25_scores AS (SELECT term_id, dc.doc_id, sum(ln(1 + ({N_DOCS} - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * ({k1}::DOUBLE + 1)) / "
        f"(tf + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * len / avgdl))) AS score "
        f"FROM dc JOIN dv USING (term) JOIN (SELECT term_id, term FROM qc) q USING (term) JOIN dl ON dl.doc_id = dc.doc_id, av GROUP BY term_id, dc.doc_id), "
        f"bm25_hits AS {best('bm25_scores', k)}"
    )


def tfidf_ctes(prefix: str, ngrams: int = 2, analyzer: str = "word", cap: int = 120000, with_queries: bool = True) -> str:
    """``{prefix}_scores(term_id, doc_id, score)``: cosine of passages and documents."""
    return (
        (f"{QUERIES}, " if with_queries else "")
        + counts_cte(f"{prefix}dc", "doc_id", "text", "documents", ngrams, analyzer)
        + ", "
        + counts_cte(f"{prefix}qc", "term_id", "text", "queries", ngrams, analyzer)
        + ", "
        + vocab_cte(f"{prefix}v", f"{prefix}dc", cap)
        + ", "
        + tfidf_cte(f"{prefix}dw", "doc_id", f"{prefix}dc", f"{prefix}v", N_DOCS)
        + ", "
        + tfidf_cte(f"{prefix}qw", "term_id", f"{prefix}qc", f"{prefix}v", N_DOCS)
        + f", {prefix}_scores AS (SELECT q.term_id, d.doc_id, sum(d.weight * q.weight) AS score FROM {prefix}dw d JOIN {prefix}qw q ON d.term = q.term GROUP BY ALL)"
    )


def dense_ctes(dimension: int = 64, with_queries: bool = True) -> str:
    """``dense_scores(term_id, doc_id, score)``: inner products of digest-bucket vectors."""

    def vec(name: str, key: str, role: str, source: str) -> str:
        return (
            f"{name}_t AS (SELECT {key}, unnest({tokens(repr(role + ': ') + ' || text')}) AS w FROM {source}), "
            f"{name}_b AS (SELECT {key}, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {dimension} AS b, count(*)::DOUBLE AS c FROM {name}_t GROUP BY ALL), "
            f"{name} AS (SELECT {key}, b, CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS FLOAT) AS DOUBLE) AS x FROM {name}_b)"
        )

    return (
        (f"{QUERIES}, " if with_queries else "")
        + vec("pv", "doc_id", "passage", "documents")
        + ", "
        + vec("qv", "term_id", "query", "queries")
        + ", dense_scores AS (SELECT term_id, doc_id, sum(qv.x * pv.x) AS score FROM qv JOIN pv ON qv.b = pv.b GROUP BY ALL)"
    )


def lists_ctes(k: int = 100) -> str:
    """``lists(source, term_id, doc_id, score, rank)`` of the three retrievers."""
    return (
        bm25_ctes(k=k)
        + ", "
        + tfidf_ctes("tw", with_queries=False)
        + ", "
        + dense_ctes(with_queries=False)
        + f", lists AS (SELECT 'bm25' AS source, * FROM {padded('bm25_hits', k)} UNION ALL SELECT 'lexical', * FROM {padded('tw_hits', k)} "
        f"UNION ALL SELECT 'semantic', * FROM {best('dense_scores', k, False)})"
    ).replace(", lists AS", f", tw_hits AS {best('tw_scores', k)}, lists AS")


def normalize_basic(c: str) -> str:
    low = rf"regexp_replace(lower(translate(coalesce({c}, ''), 'İI', 'iı')), '^\s+|\s+$', '', 'g')"
    return rf"regexp_replace(regexp_replace({low}, '[/|>\\]+', ' ', 'g'), '\s+', ' ', 'g')"


def squeezed(s: str) -> str:
    """Runs of four or more equal characters cut to two: from the third on, a character with four equal ones around it goes."""
    gone = "i > 2 AND c = l[i - 1] AND c = l[i - 2] AND (coalesce(c = l[i - 3], false) OR coalesce(c = l[i + 1], false))"
    return f"list_transform([string_split({s}, '')], lambda l: array_to_string(list_filter(l, lambda c, i: NOT ({gone})), ''))[1]"


def normalize_search(c: str, squeeze: bool = True) -> str:
    """The whole normaliser for texts that NFKC and entity decoding leave as they are, as those of the given tables."""
    s = rf"regexp_replace(lower(translate(coalesce({c}, ''), 'İI', 'iı')), '<[^>]+>', ' ', 'g')"
    s = f"translate({s}, '’–—', '''--')"
    s = rf"regexp_replace({s}, '[^\p{{L}}\p{{N}}_\s\-+]', ' ', 'g')"
    s = rf"regexp_replace({s}, '(\p{{Nd}})\s*(ml|lt|l|kg|gr|g|cm|mm|gb|tb|w|mah)([^\p{{L}}\p{{N}}_]|$)', '\1\2\3', 'g')"
    if squeeze:
        s = squeezed(s)
    return rf"trim(regexp_replace({s}, '\s+', ' ', 'g'))"

"""SQL twins of the queries over whole texts, for DuckDB."""

from __future__ import annotations

from . import secrets

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lowered(column: str) -> str:
    return f"translate(COALESCE({column}, ''), '{_UPPER}', '{_LOWER}')"


OP3_SQL = """
WITH texts AS (
  SELECT doc_id, hex(encode(COALESCE(text, ''))) AS h FROM documents
), windows AS (
  SELECT doc_id, s, md5(substr(h, 2 * s + 1, 400)) AS k
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS s FROM texts WHERE len(h) >= 400)
), twice AS (
  SELECT doc_id, s FROM windows QUALIFY COUNT(*) OVER (PARTITION BY k) > 1
), marked AS (
  SELECT doc_id, s, SUM(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run
  FROM (SELECT doc_id, s, CASE WHEN s > LAG(s) OVER (PARTITION BY doc_id ORDER BY s) + 200 THEN 1 ELSE 0 END AS fresh FROM twice)
), spans AS (
  SELECT doc_id, MIN(s) AS start, MAX(s) + 200 AS stop FROM marked GROUP BY doc_id, run
), gaps AS (
  SELECT *, COALESCE(LAG(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS before FROM spans
), kept AS (
  SELECT g.doc_id, SUM(stop - start) AS n_removed, COUNT(*) AS n_spans,
    string_agg(substr(h, 2 * before + 1, 2 * (start - before)), '' ORDER BY start) || substr(ANY_VALUE(h), 2 * MAX(stop) + 1) AS rest
  FROM gaps g JOIN texts t ON t.doc_id = g.doc_id GROUP BY g.doc_id
)
SELECT t.doc_id, len(h) // 2 AS n_bytes, CAST(COALESCE(n_removed, 0) AS BIGINT) AS n_removed, COALESCE(n_spans, 0) AS n_spans,
       sha256(unhex(COALESCE(rest, h))) AS kept_sha256
FROM texts t LEFT JOIN kept k ON k.doc_id = t.doc_id
"""


def _linked_sql(size: int, more: str = "") -> str:
    """Components of texts whose sets of ``size``-word shingles reach a similarity of 0.8."""
    return f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(string_split_regex({lowered('text')}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + {size - 1}], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {size - 1}, 1) + 1)) AS i FROM worded WHERE len(ws) > 0)
), sizes AS (
  SELECT doc_id, COUNT(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x
), roots AS (
  SELECT x, MIN(y) AS y FROM reach GROUP BY x
)
SELECT d.doc_id, COALESCE(n, 0) AS n_shingles, LEAST(d.doc_id, COALESCE(y, d.doc_id)) AS component_id{more}
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN roots r ON r.x = d.doc_id
"""


OP7_SQL = _linked_sql(5)
OP11_SQL = _linked_sql(2, ", d.doc_id = LEAST(d.doc_id, COALESCE(y, d.doc_id)) AS kept")

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP8_SQL = f"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({lowered('text')}, '{_WORD}') AS ws FROM benchmark
), phrases AS (
  SELECT DISTINCT item, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase
  FROM (SELECT item, ws, LEAST(10, len(ws)) AS size, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM items WHERE len(ws) > 0)
), worded AS (
  SELECT doc_id, regexp_extract_all({lowered('text')}, '{_WORD}') AS ws FROM documents
), grams AS (
  SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM worded, (SELECT DISTINCT size FROM phrases) z WHERE len(ws) >= size)
), hits AS (
  SELECT doc_id, g.size, i, item FROM grams g JOIN phrases p ON p.size = g.size AND p.phrase = g.phrase
), places AS (
  SELECT doc_id, COUNT(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) h GROUP BY doc_id
), found AS (
  SELECT doc_id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT w.doc_id, len(ws) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items,
       sha256(COALESCE(listed, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM worded w LEFT JOIN places p ON p.doc_id = w.doc_id LEFT JOIN found f ON f.doc_id = w.doc_id
"""


def _spans_sql(kind: str, pattern: str) -> str:
    """(doc_id, start, stop, match) of the leftmost matches of a pattern."""
    p = _quoted(pattern)
    return f"""{kind}_raw AS (
  SELECT doc_id, regexp_extract_all(t, {p}) AS hits, list_transform(string_split_regex(t, {p}), lambda x: length(x)) AS gaps
  FROM base WHERE regexp_matches(t, {p})
), {kind}_spans AS (
  SELECT doc_id, hits[i] AS m,
         list_sum(gaps[1:i]) + COALESCE(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM {kind}_raw)
)"""


def _op4_sql() -> str:
    s = secrets
    allowed = " OR ".join(f"contains(lower(m), {_quoted(a)})" for a in s.ALLOWED)
    weights = "[" + ", ".join(map(str, s.WEIGHT)) + "]"
    return f"""
WITH base AS (
  SELECT doc_id, COALESCE(text, '') AS t FROM documents
), {_spans_sql('assign', s.ASSIGN)}, {_spans_sql('access', s.ACCESS)}, {_spans_sql('hex', s.HEX)}, {_spans_sql('candidate', s.CANDIDATE)},
own AS (
  SELECT doc_id, start, 0 AS rank, start + length(m) AS stop, 'assign' AS kind FROM assign_spans
  WHERE length(regexp_extract(m, {_quoted(s.ASSIGN)}, 2)) >= {s.MIN_VALUE}
  UNION ALL SELECT doc_id, start, 1, start + length(m), 'access' FROM access_spans
  UNION ALL SELECT doc_id, start, 2, start + length(m), 'hex' FROM hex_spans
), usable AS (
  SELECT doc_id, start, m, CASE WHEN regexp_matches(m, '^[0-9a-fA-F]+$') THEN {s.limit(s.HEX_BITS)} ELSE {s.limit(s.MIXED_BITS)} END AS most
  FROM candidate_spans
  WHERE regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND NOT regexp_matches(m, {_quoted(s.UUID)}) AND NOT ({allowed})
), windows AS (
  SELECT doc_id, start, most, i, substr(m, i + 1, {s.WINDOW}) AS w
  FROM (SELECT *, unnest(range(0, length(m) - {s.WINDOW - 1})) AS i FROM usable)
), characters AS (
  SELECT doc_id, start, i, most, c, COUNT(*) AS n
  FROM (SELECT doc_id, start, i, most, unnest(string_split(w, '')) AS c FROM windows) GROUP BY ALL
), passed AS (
  SELECT doc_id, start, i FROM characters GROUP BY doc_id, start, i, most HAVING SUM({weights}[n + 1]) <= most
), marked AS (
  SELECT *, SUM(fresh) OVER (PARTITION BY doc_id, start ORDER BY i) AS run
  FROM (SELECT *, CASE WHEN i > LAG(i) OVER (PARTITION BY doc_id, start ORDER BY i) + {s.WINDOW} THEN 1 ELSE 0 END AS fresh FROM passed)
), surprising AS (
  SELECT doc_id, start + MIN(i) AS start, 3 AS rank, start + MAX(i) + {s.WINDOW} AS stop, 'entropy' AS kind FROM marked GROUP BY doc_id, marked.start, run
), every AS (
  SELECT * FROM own UNION ALL
  SELECT * FROM surprising e WHERE NOT EXISTS (SELECT 1 FROM own b WHERE b.doc_id = e.doc_id AND b.start <= e.start AND e.stop <= b.stop)
), listed AS (
  SELECT doc_id, COUNT(*) FILTER (rank = 0) AS n_assign, COUNT(*) FILTER (rank = 1) AS n_access, COUNT(*) FILTER (rank = 2) AS n_hex,
    COUNT(*) FILTER (rank = 3) AS n_entropy,
    string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank, stop) AS spans,
    string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank, stop) FILTER (rank < 3) AS own_spans
  FROM every GROUP BY doc_id
), reached AS (
  SELECT *, COALESCE(MAX(stop) OVER (PARTITION BY doc_id ORDER BY start, rank, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM every
), pieces AS (
  SELECT r.doc_id, string_agg(CASE WHEN r.start >= before OR before = 0 THEN substr(t, CAST(before AS BIGINT) + 1, CAST(r.start - before AS BIGINT)) || '[SECRET]' ELSE '' END, ''
    ORDER BY r.start, r.rank, r.stop) || substr(ANY_VALUE(t), CAST(MAX(stop) AS BIGINT) + 1) AS redacted
  FROM reached r JOIN base b ON b.doc_id = r.doc_id GROUP BY r.doc_id
)
SELECT b.doc_id, COALESCE(n_assign, 0) AS n_assign, COALESCE(n_access, 0) AS n_access, COALESCE(n_hex, 0) AS n_hex, COALESCE(n_entropy, 0) AS n_entropy,
  sha256(COALESCE(own_spans, '')) AS base_sha256, COALESCE(spans, '') AS spans, sha256(COALESCE(redacted, t)) AS redacted_sha256
FROM base b LEFT JOIN listed l ON l.doc_id = b.doc_id LEFT JOIN pieces p ON p.doc_id = b.doc_id
"""


OP4_SQL = _op4_sql()

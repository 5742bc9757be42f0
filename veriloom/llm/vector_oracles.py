"""SQL twins of the vector queries: every round is one set of common table expressions."""

from __future__ import annotations

from . import clusters, vector_codes

_FINITE = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
#: Floor of a mean of whole numbers; integer division cuts towards zero.
_FLOOR = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"


def _op12_sql() -> str:
    k, rounds, width, seed = clusters.K, clusters.ROUNDS, clusters.WIDTH, clusters.SEED
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, unnest(range(1, {width + 1})) AS d, unnest(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT))) AS x
  FROM embeddings WHERE len(embedding) = {width} AND {_FINITE}
), firsts AS (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR))) - 1 AS c FROM (SELECT DISTINCT vec_id FROM kept)
), c0 AS MATERIALIZED (
  SELECT c, d, x AS y FROM kept JOIN firsts USING (vec_id) WHERE c < {k}
)"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, c, distance FROM (SELECT vec_id, c, SUM((x - y) * (x - y)) AS distance FROM kept JOIN c{r} USING (d) GROUP BY vec_id, c)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, c) = 1
)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT o.c, o.d, COALESCE({_FLOOR}, y) AS y FROM c{r} o
  LEFT JOIN (SELECT c, d, SUM(x) AS s, COUNT(*) AS n FROM kept JOIN a{r} USING (vec_id) GROUP BY c, d) m ON m.c = o.c AND m.d = o.d
)""")
    return f"""WITH {', '.join(steps)}, named AS (
  SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c
)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(SUM(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(SUM(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN named USING (c)
"""


def _op13_sql() -> str:
    parts, entries, rounds = vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS
    steps = [
        f"""whole AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND {_FINITE}
), kept AS MATERIALIZED (
  SELECT vec_id, (d - 1) // (len(v) // {parts}) AS p, (d - 1) % (len(v) // {parts}) AS d, v[d] AS x FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS d FROM whole)
), firsts AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM whole
), c0 AS MATERIALIZED (
  SELECT p, e, d, x AS y FROM kept JOIN firsts USING (vec_id) WHERE e < {entries}
)"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, p, CAST(MIN(distance * 256 + e) % 256 AS INTEGER) AS e, CAST(MIN(distance * 256 + e) // 256 AS BIGINT) AS distance
  FROM (SELECT vec_id, p, e, SUM((x - y) * (x - y)) AS distance FROM kept JOIN c{r} USING (p, d) GROUP BY vec_id, p, e) GROUP BY vec_id, p
)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT o.p, o.e, o.d, COALESCE({_FLOOR}, y) AS y FROM c{r} o
  LEFT JOIN (SELECT p, e, d, SUM(x) AS s, COUNT(*) AS n FROM kept JOIN a{r} USING (vec_id, p) GROUP BY p, e, d) m ON m.p = o.p AND m.e = o.e AND m.d = o.d
)""")
    return f"""WITH {', '.join(steps)}, codes AS (
  SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(SUM(distance) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id
)
SELECT c.vec_id, code, error, CAST(SUM(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, d)) FROM c{rounds}) AS codebooks_sha256
FROM codes c JOIN whole w ON w.vec_id = c.vec_id
"""


OP12_SQL = _op12_sql()
OP13_SQL = _op13_sql()

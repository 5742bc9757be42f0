"""Scans, sources, sinks and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts
from ..session import scratch_path
from ..sources import files
from . import roles
from . import sql_text as Q
from .registry import query

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@query("S1_projected_scan", "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def _(t):
    return files.scan(t.spark, t.path("lineitem"), ["l_orderkey", "l_linenumber", "l_returnflag"])


def _csv_copy(df, sep: str) -> str:
    path = scratch_path(df.sparkSession, "csv")
    df.write.option("header", True).option("sep", sep).csv(path)
    return path


@query("S2_delimited_scan", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def _(t):
    path = _csv_copy(t.customer.select("c_custkey", "c_name", "c_mktsegment"), ";")
    return files.read_delimited(t.spark, path, "c_custkey long, c_name string, c_mktsegment string")


@query("S3_projected_csv_scan", "SELECT c_custkey, c_mktsegment FROM customer")
def _(t):
    path = _csv_copy(t.customer.select("c_custkey", "c_name", "c_mktsegment"), ",")
    return files.read_delimited(
        t.spark, path, "c_custkey long, c_name string, c_mktsegment string", ["c_custkey", "c_mktsegment"]
    )


@query(
    "S4_head_sample",
    """SELECT doc_id, lang, source, n_chars, 'sampled_first_100_rows' AS metric_scope
       FROM documents ORDER BY doc_id LIMIT 100""",
)
def _(t):
    return files.head_sample(t.documents.select("doc_id", "lang", "source", "n_chars"), ["doc_id"], 100)


@query(
    "S5_record_assembly",
    r"""WITH numbered AS (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
      FROM documents),
    tabbed AS (SELECT doc_id, line_no, CASE WHEN right(trim(line), 1) = '.' THEN line || chr(9) || 'end' ELSE line END AS line FROM numbered),
    rec AS (SELECT *, coalesce(count(*) FILTER (contains(line, chr(9))) OVER (
        PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS record FROM tabbed),
    joined AS (SELECT doc_id, record, string_agg(line, ' ' ORDER BY line_no) AS raw FROM rec GROUP BY doc_id, record),
    parsed AS (SELECT doc_id, record,
        trim(CASE WHEN contains(raw, chr(9)) THEN regexp_replace(raw, '\t[^\t]*$', '') ELSE raw END) AS text,
        CASE WHEN contains(raw, chr(9)) THEN trim(regexp_extract(raw, '\t([^\t]*)$', 1)) END AS label FROM joined)
    SELECT doc_id, record, md5(text) AS text_md5, label FROM parsed WHERE text <> '' OR label IS NOT NULL""",
)
def _(t):
    lines = files.split_lines(t.documents, "doc_id", "text")
    ends = F.substring(F.trim("line"), -1, 1) == "."
    lines = lines.withColumn("line", F.when(ends, F.concat("line", F.lit("\tend"))).otherwise(F.col("line")))
    return files.assemble_records(lines, "doc_id", "line_no", "line").select(
        "doc_id", "record", F.md5("text").alias("text_md5"), "label"
    )


@query(
    "S6_table_sinks",
    """WITH r AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority)
    SELECT f AS format, o_orderpriority, n FROM r, (VALUES ('parquet'), ('json'), ('csv')) v(f)""",
)
def _(t):
    report = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    base = scratch_path(t.spark, "sinks")
    out = None
    for fmt in ["parquet", "json", "csv"]:
        files.write_table(report, f"{base}/{fmt}", fmt)
        reader = t.spark.read.schema("o_orderpriority string, n long").format(fmt)
        back = (reader.option("header", True) if fmt == "csv" else reader).load(f"{base}/{fmt}")
        back = back.select(F.lit(fmt).alias("format"), "o_orderpriority", "n")
        out = back if out is None else out.unionByName(back)
    return out


@query("S7_source_report")
def _(t):
    return contracts.source_report(t.lineitem, ["l_orderkey", "l_partkey", "l_comment"])


@query(
    "S8_domain_checks",
    """SELECT 'label_outside_domain' AS check_name, count(*) FILTER (quality NOT IN (0, 1) OR quality IS NULL) AS n_bad FROM labels
       UNION ALL SELECT 'negative_weight', count(*) FILTER (toxic - 1 < 0) FROM labels""",
)
def _(t):
    weighted = t.labels.withColumn("weight", F.col("toxic") - 1)
    return contracts.violations(weighted, contracts.domain_rules("quality", [0, 1], "weight"))


@query("S9_file_inventory")
def _(t):
    return files.file_inventory(t.spark, {n: t.path(n) for n in TABLE_NAMES})


def _contents_sql(name: str) -> str:
    columns = f"SELECT string_agg(column_name, ',' ORDER BY ordinal_position) AS columns, count(*) AS n FROM information_schema.columns WHERE table_name = '{name}'"
    return f"SELECT '{name}' AS table_name, (SELECT count(*) FROM {name}) AS row_count, n AS column_count, columns, true AS readable FROM ({columns})"


@query("S9_file_contents", " UNION ALL ".join(_contents_sql(n) for n in TABLE_NAMES))
def _(t):
    """Rows and columns as the files themselves state them."""
    inventory = files.file_inventory(t.spark, {n: t.path(n) for n in TABLE_NAMES})
    return inventory.groupBy("table_name").agg(
        F.sum("row_count").alias("row_count"), F.max("column_count").cast("long").alias("column_count"), F.max("columns").alias("columns"), F.bool_and("readable").alias("readable")
    )


@query("S10_inventory_summary")
def _(t):
    return files.inventory_summary(files.file_inventory(t.spark, {n: t.path(n) for n in TABLE_NAMES}))


@query(
    "S11_batch_input_report",
    f"""WITH {roles.CUSTOMER_TEXT}
    SELECT 'missing_column' AS check_name, 'c_tenure' AS column_name, 1 AS n_bad
    UNION ALL SELECT 'empty_table', '', CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM customer_text
    UNION ALL SELECT 'not_numeric', 'c_acctbal', count(*) FILTER (TRY_CAST(trim(replace(c_acctbal, ',', '.')) AS DOUBLE) IS NULL) FROM customer_text""",
)
def _(t):
    return contracts.batch_input_report(roles.customer_text(t), ["c_custkey", "c_tenure", "c_acctbal"], ["c_acctbal"])


@query(
    "S12_text_defaults",
    """WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 9 = 0 THEN '  ' ELSE lang END AS lang, '' AS brand FROM documents)
    SELECT 'blank_text' AS check_name, count(*) FILTER (trim(text) = '') AS n_bad FROM d
    UNION ALL SELECT 'blank_lang', count(*) FILTER (trim(lang) = '') FROM d
    UNION ALL SELECT 'blank_brand', count(*) FILTER (trim(brand) = '') FROM d""",
)
def _(t):
    docs = t.documents.withColumn("lang", F.when(F.col("doc_id") % 9 == 0, "  ").otherwise(F.col("lang")))
    filled = contracts.with_text_defaults(docs, ["text", "lang", "brand"])
    return contracts.blank_text_report(filled, ["text", "lang", "brand"])


@query(
    "S13_catalogue_contract",
    f"""WITH raw AS (
      SELECT CASE WHEN doc_id % 40 = 1 THEN NULL ELSE doc_id END AS item_id, split_part(text, chr(10), 1) AS title,
             CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS category, 0 AS copy FROM documents
      UNION ALL SELECT doc_id, upper(source), lang, 1 FROM documents WHERE doc_id % 50 = 0),
    f AS (SELECT * FROM raw WHERE item_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY copy) = 1),
    c AS (SELECT item_id, coalesce(title, '') AS title, coalesce(category, '') AS category FROM f)
    SELECT item_id, md5(title) AS title_md5, category, CASE WHEN trim(title) = '' THEN 1 ELSE 0 END AS title_missing,
           CASE WHEN trim(category) = '' THEN 1 ELSE 0 END AS category_missing
    FROM c WHERE {Q.normalize_search('title')} <> '' OR {Q.normalize_search('category')} <> ''""",
)
def _(t):
    base = t.documents.select(
        F.when(F.col("doc_id") % 40 != 1, F.col("doc_id")).alias("item_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("category"),
        F.lit(0).alias("copy"),
    )
    again = t.documents.where(F.col("doc_id") % 50 == 0).select(
        F.col("doc_id").alias("item_id"), F.upper("source").alias("title"), F.col("lang").alias("category"), F.lit(1).alias("copy")
    )
    out = contracts.prepare_catalogue(base.unionByName(again), "item_id", ["copy"], ["title", "category"])
    return out.select("item_id", F.md5("title").alias("title_md5"), "category", "title_missing", "category_missing")


@query(
    "S14_judgment_contract",
    f"""WITH {roles.JUDGMENTS}, {roles.CATALOGUE},
    twice AS (SELECT * FROM judgments UNION ALL SELECT * FROM judgments WHERE item_id % 5 = 0),
    cat AS (SELECT item_id FROM catalogue WHERE category = 'en'),
    pairs AS (SELECT term_id, item_id, count(*) AS n, sum(relevance_label) AS pos FROM twice GROUP BY ALL)
    SELECT CAST(sum(n) AS BIGINT) AS "rows", count(DISTINCT term_id) AS "groups", count(*) FILTER (n > 1) AS duplicate_pairs,
           CAST(sum(pos) AS BIGINT) AS positives,
           round(CAST(sum(CASE WHEN item_id IN (SELECT item_id FROM cat) THEN pos ELSE 0 END) AS DOUBLE) / sum(pos), 6) AS positive_availability
    FROM pairs""",
)
def _(t):
    j = roles.judgments(t)
    twice = j.unionByName(j.where(F.col("item_id") % 5 == 0))
    english = roles.catalogue(t).where(F.col("category") == "en").select("item_id")
    return contracts.judgment_report(twice, english, "term_id", "item_id", "relevance_label")


_LANES = ", ".join(
    f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS VARCHAR) AS l{i}" for i in range(4)
)


@query(
    "S15_content_fingerprint",
    f"""WITH h AS (SELECT md5({' || '.join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-;')" for c in ('p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size'))}) AS h FROM part),
    s AS (SELECT count(*) AS n, {_LANES} FROM h)
    SELECT n AS "rows", sha256(concat_ws('|', CAST(n AS VARCHAR), l0, l1, l2, l3)) AS fingerprint FROM s""",
)
def _(t):
    return contracts.content_fingerprint(t.part, ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])


@query(
    "S16_embedding_contract",
    """WITH v AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS nrm FROM embeddings)
    SELECT count(*) AS "rows", count(*) FILTER (len(embedding) <> 64) AS wrong_dimension,
           count(*) FILTER (len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0) AS not_finite,
           count(*) FILTER (abs(nrm - 1) > 1e-3) AS not_unit, round(min(nrm), 4) AS norm_min, round(avg(nrm), 4) AS norm_mean,
           round(max(nrm), 4) AS norm_max FROM v""",
)
def _(t):
    return contracts.embedding_report(t.embeddings, "embedding", 64)


@query(
    "S16_embedding_alignment",
    """SELECT count(*) FILTER (d.doc_id IS NULL) AS only_left, count(*) FILTER (e.vec_id IS NULL) AS only_right,
              count(*) FILTER (d.doc_id IS NOT NULL AND e.vec_id IS NOT NULL) AS both_sides
       FROM embeddings e FULL JOIN documents d ON e.vec_id = d.doc_id""",
)
def _(t):
    return contracts.id_alignment(t.embeddings, t.documents, "vec_id", "doc_id")

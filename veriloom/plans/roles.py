"""How the given tables stand in for the roles the operators work on.

Each role has a Spark form and the same thing as a SQL common table
expression for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hash_unit
from ..operators import retrieval as R
from ..session import scratch_path, through_table

# --- tables with injected faults -------------------------------------------------


def orders_nulled(t) -> DataFrame:
    seventh = F.col("o_orderkey") % 7 == 0
    return t.orders.select(
        "o_orderkey",
        "o_custkey",
        F.when(~seventh, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(~seventh, F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderpriority",
        F.lit(None).cast("string").alias("o_comment"),
    )


ORDERS_NULLED = """orders_nulled AS (
  SELECT o_orderkey, o_custkey,
         CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice,
         o_orderpriority, CAST(NULL AS VARCHAR) AS o_comment
  FROM orders)"""


def orders_repeated(t) -> DataFrame:
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    base = t.orders.select(*cols)
    return base.unionByName(base.where(F.col("o_orderkey") % 50 == 0))


ORDERS_REPEATED = """orders_repeated AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
  UNION ALL
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 50 = 0)"""


def events_repeated(t) -> DataFrame:
    base = t.events.select("event_id", "user_id", "event_type", "value")
    return base.withColumn("copy", F.lit(0)).unionByName(
        base.where(F.col("event_id") % 50 == 0).withColumn("copy", F.lit(1))
    )


EVENTS_REPEATED = """events_repeated AS (
  SELECT event_id, user_id, event_type, value, 0 AS copy FROM events
  UNION ALL
  SELECT event_id, user_id, event_type, value, 1 AS copy FROM events WHERE event_id % 50 = 0)"""


def customer_text(t) -> DataFrame:
    return t.customer.select(
        "c_custkey",
        "c_mktsegment",
        F.when(F.col("c_custkey") % 11 == 0, F.lit("n/a"))
        .otherwise(F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(",")))
        .alias("c_acctbal"),
    )


CUSTOMER_TEXT = """customer_text AS (
  SELECT c_custkey, c_mktsegment,
         CASE WHEN c_custkey % 11 = 0 THEN 'n/a' ELSE replace(CAST(c_acctbal AS VARCHAR), '.', ',') END AS c_acctbal
  FROM customer)"""

# --- customers with order history ------------------------------------------------


def customer_role(t) -> DataFrame:
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    history = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        (F.max(month) - F.min(month)).alias("tenure"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )
    return (
        t.customer.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
        .join(history, "c_custkey", "left")
        .select(
            "c_custkey",
            "c_nationkey",
            "c_acctbal",
            F.col("c_mktsegment").alias("contract"),
            F.coalesce("tenure", F.lit(0)).alias("tenure"),
            "total",
            (F.coalesce("total", F.lit(0.0)) / F.greatest(F.coalesce("tenure", F.lit(0)), F.lit(1))).alias("monthly"),
        )
    )


CUSTOMER_ROLE = """history AS (
  SELECT o_custkey AS c_custkey,
         max(year(o_orderdate) * 12 + month(o_orderdate)) - min(year(o_orderdate) * 12 + month(o_orderdate)) AS tenure,
         round(sum(o_totalprice), 2) AS total
  FROM orders GROUP BY o_custkey),
customer_role AS (
  SELECT c.c_custkey, c_nationkey, c_acctbal, c_mktsegment AS contract, coalesce(tenure, 0) AS tenure, total,
         coalesce(total, 0) / greatest(coalesce(tenure, 0), 1) AS monthly
  FROM customer c LEFT JOIN history h ON c.c_custkey = h.c_custkey)"""

# --- order lines as transactions --------------------------------------------------


def transactions(t) -> DataFrame:
    return (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "l_orderkey",
            "l_linenumber",
            F.col("n_name").alias("city"),
            F.col("c_mktsegment").alias("category"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"),
            F.date_diff("l_shipdate", "o_orderdate").alias("delivery_days"),
            F.when(F.col("l_orderkey") % 7 != 0, F.col("l_linenumber")).alias("rating"),
        )
    )


TRANSACTIONS = """transactions AS (
  SELECT l_orderkey, l_linenumber, n_name AS city, c_mktsegment AS category,
         l_extendedprice / l_quantity AS unit_price, l_extendedprice * (1 - l_discount) AS amount,
         date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS delivery_days,
         CASE WHEN l_orderkey % 7 <> 0 THEN l_linenumber END AS rating
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

# --- scored binary events ----------------------------------------------------------


def scored(t) -> DataFrame:
    return (
        t.events.select(
            "event_id",
            "user_id",
            "event_type",
            "value",
            (F.col("event_type") == "purchase").cast("int").alias("label"),
            (F.floor(hash_unit(42, "event_id") * 1000) / 1000).alias("p"),
        )
        .withColumn("prediction", (F.col("p") >= 0.5).cast("int"))
    )


def sql_unit(expr: str, seed: str = "42") -> str:
    """SQL twin of ``hash_unit`` over one text expression."""
    return f"(CAST(CAST('0x' || substr(md5('{seed}|' || {expr}), 1, 8) AS BIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE))"


SCORED = f"""scored0 AS (
  SELECT event_id, user_id, event_type, value, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label,
         floor({sql_unit('CAST(event_id AS VARCHAR)')} * 1000) / 1000 AS p
  FROM events),
scored AS (SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS prediction FROM scored0)"""

# --- grouped ranking ---------------------------------------------------------------


def graded_events(t) -> DataFrame:
    return t.events.select(
        F.col("user_id").alias("term_id"),
        F.col("event_id").alias("item_id"),
        (F.col("event_type") == "purchase").cast("int").alias("label"),
        F.col("value").alias("score"),
        hash_unit(7, "event_id").alias("score_b"),
    )


GRADED_EVENTS = f"""graded AS (
  SELECT user_id AS term_id, event_id AS item_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label,
         value AS score, {sql_unit('CAST(event_id AS VARCHAR)', '7')} AS score_b
  FROM events)"""

# --- documents as a catalogue ------------------------------------------------------


def catalogue(t) -> DataFrame:
    return t.documents.select(
        F.col("doc_id").alias("item_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("lang").alias("category"),
        F.col("source").alias("brand"),
        F.col("text").alias("attributes"),
    )


CATALOGUE = """catalogue AS (
  SELECT doc_id AS item_id, split_part(text, chr(10), 1) AS title, lang AS category, source AS brand,
         text AS attributes FROM documents)"""


def passages(t) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("term_id"), F.col("text").alias("query"))


def judgments(t) -> DataFrame:
    return stored(t, "judgments", lambda: _judgments(t))


def _judgments(t) -> DataFrame:
    """Documents that contain a whole passage.

    A contained passage brings along every run of its inner words, so an
    equality join on one run of up to six of them finds all candidates and the
    containment test only confirms them. Passages of one or two words have no
    inner word; their first characters, up to four, are looked up instead. Both
    kinds of digest are plain longs: distinct per document, and met by the few
    wanted ones under Spark's own size check. Digests of a kind that no passage
    needs are not made.
    """
    split = F.split("text", r"\s+").alias("ws")
    wanted = t.benchmark.where("text is not null").select(F.col("item_id").alias("term_id"), F.col("text").alias("passage"), split)
    inner, head = F.least(F.lit(6), F.size("ws") - 2), F.least(F.lit(4), F.length("passage"))
    wanted = wanted.withColumn("inner", F.greatest(inner, F.lit(0))).withColumn("head", F.when(inner > 0, F.lit(0)).otherwise(head))
    kinds = [tuple(r) for r in wanted.select("inner", "head").distinct().collect()]  # at most six and five numbers
    docs = t.documents.select("doc_id", "text", split, F.split("text", "").alias("cs"))

    def runs(items: str, n: int, first: Column) -> Column:
        """Digests of all runs of ``n`` items."""
        digest = F.transform(first, lambda i: F.xxhash64(F.lit(n), *[F.get(items, i + k) for k in range(n)]))
        return F.when(F.size(items) >= n, F.array_distinct(digest)).otherwise(F.array().cast("array<bigint>"))

    def everywhere(items: str, n: int) -> Column:
        return runs(items, n, F.sequence(F.lit(0), F.size(items) - n))

    found = docs.select(F.lit(0).cast("long").alias("term_id"), "doc_id").limit(0)
    if any(n for kind in kinds for n in kind):
        widths, heads = sorted({w for w, _ in kinds if w}), sorted({h for _, h in kinds if h})
        own = F.coalesce(
            *[F.when(F.col("inner") == w, runs("ws", w, F.array(F.lit(1)))) for w in widths],
            *[F.when(F.col("head") == h, runs("cs", h, F.array(F.lit(0)))) for h in heads],
        )
        probe = wanted.where("inner > 0 or head > 0").withColumn("cs", F.split("passage", "")).select("term_id", "passage", F.get(own, F.lit(0)).alias("run"))
        made = F.flatten(F.array(*[everywhere("ws", w) for w in widths], *[everywhere("cs", h) for h in heads]))
        entries = docs.select("doc_id", F.explode(made).alias("run"))
        # Written first: Spark then knows that they are few, and does not move the texts to them.
        candidates = through_table(entries.join(probe, "run").select("term_id", "doc_id", "passage").distinct(), "candidates")
        found = found.unionByName(
            candidates.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", F.col("passage"))).select("term_id", "doc_id")
        )
    if (0, 0) in kinds:  # an empty passage is in every text
        blank = wanted.where("passage = ''").agg(F.collect_list("term_id")).scalar()
        found = found.unionByName(docs.where("text is not null").select(F.explode(blank).alias("term_id"), "doc_id"))
    return found.select("term_id", F.col("doc_id").alias("item_id"), F.lit(1).alias("relevance_label"))


JUDGMENTS = """judgments AS (
  SELECT b.item_id AS term_id, d.doc_id AS item_id, 1 AS relevance_label
  FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""


def review_texts(t) -> DataFrame:
    return t.documents.join(t.labels, "doc_id").select("doc_id", "text", "source", "lang", "quality", "toxic")


# --- retrieval lists and pairs -------------------------------------------------------

_MEMO: dict[tuple, object] = {}


def _once(t, name: str, build):
    key = (t.spark.sparkContext.applicationId, t.folder, name)
    if key not in _MEMO:
        _MEMO[key] = build()
    return _MEMO[key]


#: Rows in a file of a table that fits read. Spark counts 4 MB for opening a file, so its tasks read at most 32 of them.
FIT_ROWS = 50_000


def stored(t, name: str, build, rows: int | None = None) -> DataFrame:
    """A result shared by several queries, written once to the shared folder.

    Reading the written table cuts the plan: later queries neither repeat the
    work nor carry its whole lineage, and a lost executor loses nothing. Files
    of at most ``rows`` rows bound the rows of a later task without an exchange.
    """

    def write():
        path = scratch_path(t.spark, name)
        df = build()
        if rows is not None:
            df.write.option("maxRecordsPerFile", rows).parquet(path)
            return path, df.schema
        tasks = int(t.spark.conf.get("spark.sql.shuffle.partitions"))  # as many files as later readers want tasks
        df.repartition(tasks).write.parquet(path)
        return path, df.schema

    path, schema = _once(t, name, write)
    return t.spark.read.schema(schema).parquet(path)


def index(t, analyzer: str = "word", ngrams: int = 1):
    """The document index of one analyzer, built once per session; words are taken from an index with word pairs that is there."""

    def build():
        wider = (t.spark.sparkContext.applicationId, t.folder, "index_word_2")
        if (analyzer, ngrams) == ("word", 1) and wider in _MEMO:
            return R.build_word_index(_MEMO[wider])
        return R.build_index(t.documents, "doc_id", "text", analyzer=analyzer, ngrams=ngrams)

    return _once(t, f"index_{analyzer}_{ngrams}", build)


def bm25_lists(t, k: int = 100) -> DataFrame:
    return stored(t, f"bm25_{k}", lambda: R.search_bm25(index(t), passages(t), "term_id", "query", k))


def retrieval_lists(t) -> DataFrame:
    """``(source, term_id, doc_id, score, rank)``: top 100 of three retrievers."""

    def build():
        lexical = R.search_tfidf(index(t, ngrams=2), passages(t), "term_id", "query", 100)
        encoder = R.hashing_encoder(64)
        texts = t.documents.where("text is not null").select("doc_id", "text")  # null has no vector, a blank text that of its prefix
        docs = R.encode_texts(texts, "text", "passage", encoder, 64, allow_blank=True)
        queries = R.encode_texts(passages(t).where("query is not null"), "query", "query", encoder, 64, allow_blank=True)
        semantic = R.search_dense(docs, "doc_id", "embedding", queries, "term_id", "embedding", 100)
        cols = ["source", "term_id", "doc_id", "score", "rank"]
        parts = [("bm25", bm25_lists(t)), ("lexical", lexical), ("semantic", semantic)]
        out = None
        for name, part in parts:
            part = part.withColumn("source", F.lit(name)).select(*cols)
            out = part if out is None else out.unionByName(part)
        return out

    return stored(t, "lists", build)


def pairs(t) -> DataFrame:
    """Passages with their top 50 documents, labelled by the judgments."""
    return stored(t, "pairs", lambda: _pairs(t))


def _pairs(t) -> DataFrame:
    top = bm25_lists(t).where("rank <= 50 and score > 0").select("term_id", "doc_id", "score")
    judged = judgments(t).select("term_id", F.col("item_id").alias("doc_id"), "relevance_label")
    docs = t.documents.select(
        "doc_id",
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("lang").alias("category"),
        F.col("source").alias("brand"),
        F.col("text").alias("attributes"),
    )
    labelled = through_table(top.join(judged, ["term_id", "doc_id"], "left"), "labelled")  # few rows beside the texts, as Spark then knows
    return (
        labelled.join(docs, "doc_id")
        .join(passages(t), "term_id")
        .select(
            "term_id", "doc_id", "query", "title", "category", "brand", "attributes",
            F.coalesce("relevance_label", F.lit(0)).alias("label"), F.round("score", 9).alias("bm25"),
        )
    )


def pairs_ctes() -> str:
    from . import sql_text as Q

    return (
        Q.bm25_ctes(k=50)
        + f", {JUDGMENTS}, pairs AS (SELECT h.term_id, h.doc_id, q.text AS query, split_part(d.text, chr(10), 1) AS title, "
        "d.lang AS category, d.source AS brand, d.text AS attributes, coalesce(j.relevance_label, 0) AS label, h.score AS bm25 "
        "FROM bm25_hits h LEFT JOIN judgments j ON j.term_id = h.term_id AND j.item_id = h.doc_id "
        "JOIN documents d ON d.doc_id = h.doc_id JOIN queries q ON q.term_id = h.term_id)"
    )

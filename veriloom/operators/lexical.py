"""A term index on disk and exact top-k search that does not score every match.

Scores are sums over terms, and the index knows the largest contribution each
term can make. Where that leaves few documents, a search reads the postings of
rare terms and looks at those of frequent terms only for documents that can
still reach the top k. Where it does not, every posting of a query term goes to
the task of its document once, and the sums are made there.

Documents that hold the same terms equally often score alike for every query.
A search of one index scores the smallest id of them, and the others enter
beside it at the end.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import through_table
from .features import idf, term_counts, vocabulary
from .ordered import join_groups, top_k

SCORE_DIGITS = 9
BUCKETS = 32
#: Sums of one score in another order differ by less; nothing this close to a threshold is dropped.
SLACK = 1e-8
#: Query terms that every task of a search over all matches holds at once.
ASKED_ROWS = 200_000


@dataclass(frozen=True)
class LexicalIndex:
    """Postings and terms in buckets by term, and what all scores share.

    ``postings``: term, document, tf, dl (tokens of the vocabulary in the
    document), weight (unit-length TF-IDF) and single (no smaller id holds the
    same terms equally often). ``terms``: term, df, cf and the extremes that
    bound a contribution. ``copies``: every document that is not single beside
    the one (``_first``) that is.
    """

    path: str
    doc: str
    analyzer: str
    ngrams: int
    min_df: int
    max_features: int | None
    buckets: int
    generation: int
    n_docs: int
    mean_length: float
    fingerprint: str
    postings: DataFrame
    terms: DataFrame
    copies: DataFrame
    docs: DataFrame


# --- building -------------------------------------------------------------------------


def write_index(
    docs: DataFrame,
    doc: str,
    text: str | Column,
    path: str,
    analyzer: str = "word",
    ngrams: int = 1,
    min_df: int = 2,
    max_features: int | None = None,
    buckets: int = BUCKETS,
) -> LexicalIndex:
    """Index ``docs`` in a new folder ``path``; ``open_index`` reads it in any later session."""
    _write_batch(docs, doc, text, path, analyzer, ngrams, buckets, 0)
    return _derive(docs.sparkSession, path, doc, analyzer, ngrams, min_df, max_features, buckets, 0)


def write_word_index(index: LexicalIndex, path: str) -> LexicalIndex:
    """The index of the single words of an index of words and word pairs, in a new folder ``path``; no text is read again."""
    if (index.analyzer, index.ngrams) != ("word", 2):
        raise ValueError("only an index of words and word pairs holds single words")
    spark = index.docs.sparkSession
    for batch in range(index.generation + 1):
        counts = _bucketed_table(spark, f"{index.path}/counts/batch={batch}", index.buckets)
        _in_buckets(counts.where(~F.contains("term", F.lit(" "))), f"{path}/counts/batch={batch}", index.buckets)
        spark.read.parquet(f"{index.path}/documents/batch={batch}").write.parquet(f"{path}/documents/batch={batch}")
    return _derive(spark, path, index.doc, "word", 1, index.min_df, index.max_features, index.buckets, index.generation)


def append_documents(index: LexicalIndex, docs: DataFrame, text: str | Column) -> LexicalIndex:
    """The index with one more batch of documents.

    Only the new texts are tokenised. Every weight depends on how many
    documents hold a term, so postings are written anew as the next generation;
    readers of the earlier one are not disturbed.
    """
    generation = index.generation + 1
    _write_batch(docs, index.doc, text, index.path, index.analyzer, index.ngrams, index.buckets, generation)
    return _derive(
        docs.sparkSession, index.path, index.doc, index.analyzer, index.ngrams, index.min_df, index.max_features, index.buckets, generation
    )


def _write_batch(docs: DataFrame, doc: str, text: str | Column, path: str, analyzer: str, ngrams: int, buckets: int, batch: int) -> None:
    """Counts with the number of documents of the batch that hold the term; counting it brings the rows in order of terms."""
    counts = term_counts(docs, doc, text, analyzer, ngrams).select("term", doc, "tf").repartition(buckets, "term")
    held = F.count(F.lit(1)).over(Window.partitionBy("term"))
    _in_buckets(counts.withColumn("df", held), f"{path}/counts/batch={batch}", buckets)
    docs.select(doc).write.parquet(f"{path}/documents/batch={batch}")


def _derive(spark, path, doc, analyzer, ngrams, min_df, max_features, buckets, generation) -> LexicalIndex:
    """Terms and postings of all batches.

    Counts lie in buckets by term, so counting and weighing terms needs no
    exchange; what is shuffled are sums per document. With one batch the
    postings stay in their buckets from the first read to the last write, and
    the counts already know how many documents hold a term.
    """
    if generation:  # read as plain files: a union of bucketed tables does not gather the rows of a term
        files = spark.read.parquet(*[f"{path}/counts/batch={batch}" for batch in range(generation + 1)])
        counts = files.drop("df").repartition(buckets, "term")
    else:
        counts = _bucketed_table(spark, f"{path}/counts/batch=0", buckets)
    docs = spark.read.parquet(f"{path}/documents").where(F.col("batch") <= generation).select(doc)
    n_docs = docs.count()
    weight = (1 + F.log("tf")) * idf(F.col("df"), F.lit(n_docs))
    home = f"{path}/generation={generation}"
    if generation or max_features is not None:
        vocab = _in_buckets(vocabulary(counts, min_df, max_features).select("term", "df"), f"{home}/vocabulary", buckets)
        known = counts.drop("df").join(vocab.hint("merge"), "term")
    else:
        known = counts.where(F.col("df") >= min_df)
    weighted = known.withColumn("_w", weight)
    sums = weighted.groupBy(doc).agg(F.sum("tf").alias("dl"), F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"), *_marks())
    lengths = _with_first(through_table(sums, "sums"), doc)
    postings = weighted.join(lengths, doc).select(
        "term", doc, F.col("tf").cast("long").alias("tf"), "dl", (F.col("_w") / F.col("_norm")).alias("weight"), (F.col(doc) == F.col("_first")).alias("single")
    )
    lengths.where(F.col(doc) != F.col("_first")).select("_first", doc).write.parquet(f"{home}/copies")
    stored = _in_buckets(postings, f"{home}/postings", buckets)
    terms = stored.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("weight").alias("max_weight"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl")
    )
    kept = _in_buckets(terms, f"{home}/terms", buckets)
    marks = stored.agg(F.sum(F.xxhash64(doc, "term", "tf").cast("decimal(38,0)")).cast("string").alias("a"), F.count(F.lit(1)).alias("b"), F.sum("tf").alias("c")).first()
    fingerprint = hashlib.sha256(f"{analyzer}|{ngrams}|{min_df}|{max_features}|{n_docs}|{marks['a']}|{marks['b']}".encode()).hexdigest()[:16]
    mean = max((marks["c"] or 0) / n_docs if n_docs else 0.0, 1.0)
    facts = [(doc, analyzer, ngrams, min_df, max_features, buckets, generation, n_docs, mean, fingerprint)]
    spark.createDataFrame(facts, _FACTS).coalesce(1).write.parquet(f"{path}/manifest/generation={generation}")
    return LexicalIndex(path, *facts[0], stored, kept, _copies(docs, doc, home), docs)


def _marks() -> list[Column]:
    """Two hashes of the terms of a document with their counts, in any order: 128 bits, together with its length."""
    return [F.bit_xor(F.xxhash64(F.lit(n), "term", F.col("tf").cast("long"))).alias(f"_mark{n}") for n in range(2)]


def _with_first(lengths: DataFrame, doc: str) -> DataFrame:
    """``lengths`` with the smallest document of the same terms and counts as ``_first``."""
    same = ["_mark0", "_mark1", "dl"]
    alike = lengths.groupBy(*same).agg(F.min(doc).alias("_least"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    joined = join_groups(lengths, through_table(alike, "alike"), same, "_n", "left")
    return through_table(joined.select(doc, "dl", "_norm", F.coalesce("_least", doc).alias("_first")), "lengths")


def _copies(docs: DataFrame, doc: str, home: str) -> DataFrame:
    kind = dict(docs.dtypes)[doc]
    return docs.sparkSession.read.schema(f"`_first` {kind}, `{doc}` {kind}").parquet(f"{home}/copies")


_FACTS = "doc string, analyzer string, ngrams int, min_df int, max_features int, buckets int, number int, n_docs long, mean_length double, fingerprint string"


def open_index(spark: SparkSession, path: str) -> LexicalIndex:
    """The latest whole generation at ``path``; nothing is built."""
    row = spark.read.parquet(f"{path}/manifest").orderBy(F.desc("number")).select(*[c.split()[0] for c in _FACTS.split(", ")]).first()
    home = f"{path}/generation={row['number']}"
    docs = spark.read.parquet(f"{path}/documents").where(F.col("batch") <= row["number"]).select(row["doc"])
    tables = [_bucketed_table(spark, f"{home}/{name}", row["buckets"]) for name in ("postings", "terms")]
    return LexicalIndex(path, *row, *tables, _copies(docs, row["doc"], home), docs)


def _table_name(path: str) -> str:
    return f"index_{hashlib.md5(path.encode()).hexdigest()}"


def _in_buckets(df: DataFrame, path: str, buckets: int) -> DataFrame:
    """Write buckets by term, in the order the rows come; rows that are dealt by term already make few files.

    No ``sortBy``: Spark would find the bucket of both terms anew in every comparison of that sort, and does not rely on
    the order when it reads.
    """
    name = _table_name(path)
    df.write.format("parquet").option("path", path).bucketBy(buckets, "term").saveAsTable(name)
    return df.sparkSession.table(name)


def _bucketed_table(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{c}` {kind}" for c, kind in spark.read.parquet(path).dtypes)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (term) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def index_statistics(index: LexicalIndex) -> DataFrame:
    """Postings, terms, documents and the bytes of a compressed sparse row form."""
    return index.terms.agg(
        F.sum("df").alias("postings"),
        F.sum("cf").alias("term_occurrences"),
        F.count(F.lit(1)).alias("vocabulary"),
        F.lit(index.n_docs).cast("long").alias("documents"),
        (F.sum("df") * 12 + (F.lit(index.n_docs) + 1) * 4).alias("index_bytes"),
    )


# --- searching ------------------------------------------------------------------------


@dataclass(frozen=True)
class Scoring:
    """What the postings of one index add to a score.

    ``terms`` holds (query, term, df, bound), the columns that ``value`` needs
    beside those of the postings (``shared``, the same for all queries of a
    term) and those of ``factor``. A gain is ``value * factor`` and does not
    exceed its ``bound``.
    """

    index: LexicalIndex
    terms: DataFrame
    value: Column
    factor: Column
    shared: tuple[str, ...] = ()

    @property
    def gain(self) -> Column:
        return self.value * self.factor


def _asked(index: LexicalIndex, queries: DataFrame, query: str, text: str) -> DataFrame:
    """Terms of the queries that the index knows."""
    counts = through_table(term_counts(queries, query, text, index.analyzer, index.ngrams).withColumnRenamed("tf", "_qtf"), "query-terms")
    return _of_terms(index, index.terms, counts).join(counts, "term")


def _of_terms(index: LexicalIndex, table: DataFrame, terms: DataFrame) -> DataFrame:
    """``table`` with a filter that lets Spark skip buckets, while the terms are so few that some can be skipped."""
    few = 2 * index.buckets
    found = [r[0] for r in terms.select("term").distinct().limit(few + 1).collect()]
    return table.where(F.col("term").isin(found)) if len(found) <= few else table


def tfidf_scoring(index: LexicalIndex, queries: DataFrame, query: str, text: str, share: float = 1.0) -> Scoring:
    """``share`` of the cosine of unit-length TF-IDF vectors."""
    asked = _asked(index, queries, query, text).withColumn("_w", (1 + F.log("_qtf")) * idf(F.col("df"), F.lit(index.n_docs)))
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(query)))
    weighted = asked.withColumn("_qw", F.lit(share) * F.col("_w") / length)
    return Scoring(index, weighted.select(query, "term", "df", (F.col("_qw") * F.col("max_weight")).alias("bound"), "_qw"), F.col("weight"), F.col("_qw"))


def bm25_scoring(index: LexicalIndex, queries: DataFrame, query: str, text: str, k1: float = 1.5, b: float = 0.75) -> Scoring:
    """BM25; lengths and their mean count words of the vocabulary, every distinct query word counts once.

    A gain grows with tf and falls with dl, so the extremes of both bound it.
    """
    df = F.col("df")

    def gain(tf: Column, dl: Column) -> Column:
        return F.col("_idf") * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * dl / F.lit(index.mean_length)))

    asked = _asked(index, queries, query, text).withColumn("_idf", F.log(1 + (F.lit(index.n_docs) - df + 0.5) / (df + 0.5)))
    return Scoring(index, asked.select(query, "term", "df", gain(F.col("max_tf"), F.col("min_dl")).alias("bound"), "_idf"), gain(F.col("tf"), F.col("dl")), F.lit(1.0), ("_idf",))


def _placed(parts: list[Scoring], query: str, k: int) -> list[Scoring]:
    """Terms with their place in the query, rare ones first.

    ``_rest`` is the most that a term and all later ones can add; ``_seed``
    marks the first terms, about ``4 k`` postings and one term at least.
    """
    order = ["df", "term", "_part"]
    every = None
    for n, part in enumerate(parts):
        own = part.terms.select(query, "term", "df", "bound", F.lit(n).alias("_part"))
        every = own if every is None else every.unionByName(own)
    before = Window.partitionBy(query).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(query).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    places = every.select(
        query, "term", "_part", (F.coalesce(F.sum("df").over(before), F.lit(0)) < 4 * k).alias("_seed"), F.sum("bound").over(after).alias("_rest")
    )
    placed = [p.terms.join(places.where(F.col("_part") == n).drop("_part"), [query, "term"]) for n, p in enumerate(parts)]
    return [replace(p, terms=through_table(terms, "placed-terms")) for p, terms in zip(parts, placed)]


def _postings(parts: list[Scoring], part: Scoring) -> DataFrame:
    """Postings that a search needs: with one index, of one document of several alike; two indexes may tell them apart."""
    return part.index.postings.where("single") if len(parts) == 1 else part.index.postings


def _gains(parts: list[Scoring], query: str, doc: str, chosen: Column) -> DataFrame:
    """(query, document, gain) of the postings of the chosen terms."""
    out = None
    for p in parts:
        terms = p.terms.where(chosen)
        rows = _of_terms(p.index, _postings(parts, p), terms).join(terms, "term").select(query, F.col(p.index.doc).alias(doc), p.gain.alias("_gain"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _looked_up(parts: list[Scoring], pairs: DataFrame, query: str, doc: str, chosen: Column) -> DataFrame:
    """(query, document, gain) of the chosen terms for the given pairs only."""
    out = None
    for p in parts:
        terms = p.terms.where(chosen)
        wanted = pairs.select(query, doc).join(terms, query)
        postings = _postings(parts, p).withColumnRenamed(p.index.doc, doc)
        rows = postings.join(wanted, ["term", doc]).select(query, doc, p.gain.alias("_gain"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _summed(gains: DataFrame, query: str, doc: str, name: str) -> DataFrame:
    return gains.groupBy(query, doc).agg(F.sum("_gain").alias(name))


def _floored(parts: list[Scoring], query: str, doc: str, k: int) -> list[Scoring]:
    """The parts with a score that the best ``k`` of a query reach: the k-th best sum over its rarest terms."""
    parts = _placed(parts, query, k)
    seeds = top_k(_summed(_gains(parts, query, doc, F.col("_seed")), query, doc, "_s"), k, [F.desc("_s"), F.asc(doc)], [query])
    reached = seeds.groupBy(query).agg(F.count(F.lit(1)).alias("_n"), F.min("_s").alias("_least")).where(F.col("_n") >= k)
    floors = through_table(reached.select(query, (F.col("_least") - SLACK).alias("_floor")), "floors")
    return [replace(p, terms=p.terms.join(floors, query, "left").withColumn("_floor", F.coalesce("_floor", F.lit(0.0)))) for p in parts]


def _kept(floored: list[Scoring], query: str, doc: str) -> DataFrame:
    partial = _summed(_gains(floored, query, doc, F.col("_rest") >= F.col("_floor")), query, doc, "_s")
    dropped = None
    for p in floored:
        own = p.terms.where("_rest < _floor").select(query, "_rest", "_floor")
        dropped = own if dropped is None else dropped.unionByName(own)
    limits = dropped.groupBy(query).agg(F.max("_rest").alias("_rest"), F.first("_floor").alias("_floor"))
    kept = partial.join(limits, query, "left").where(F.col("_floor").isNull() | (F.col("_s") + F.col("_rest") >= F.col("_floor")))
    return kept.select(query, doc, "_s")


def candidates(parts: list[Scoring], query: str, doc: str, k: int) -> tuple[DataFrame, list[Scoring]]:
    """((query, document, partial score) that can still be among the best, the parts with thresholds).

    1. The k-th best sum over the rarest terms is a threshold that the true
       k-th score reaches.
    2. Terms are dropped from the end while all dropped ones together stay below
       the threshold. A document without any other term cannot enter.
    3. Documents with other terms stay if these plus all that the dropped terms
       could add reach the threshold.
    """
    floored = _floored(parts, query, doc, k)
    return _kept(floored, query, doc), floored


def _bounds_help(floored: list[Scoring], query: str) -> bool:
    """Whether postings of kept terms and look-ups of dropped ones are fewer than all postings, whatever documents they meet."""
    every = None
    for p in floored:
        own = p.terms.select(query, "df", (F.col("_rest") < F.col("_floor")).alias("_out"))
        every = own if every is None else every.unionByName(own)
    per = every.groupBy(query).agg(
        F.sum("df").alias("_all"), F.sum(F.when(F.col("_out"), 0).otherwise(F.col("df"))).alias("_read"), F.count_if("_out").alias("_dropped")
    )
    row = per.agg(F.sum("_all").alias("a"), F.sum(F.col("_read") * (1 + F.col("_dropped"))).alias("b")).first()
    return (row["b"] or 0) < (row["a"] or 0)


def _every_match(parts: list[Scoring], query: str, doc: str) -> DataFrame:
    """(query, document, score) of every match.

    A posting goes to the task of its document once, as its value and the
    number of its term; what the queries make of it stays in that task, and
    only the best of it leaves. Query terms are taken in blocks that fit a task.
    """
    spark = parts[0].index.docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a fixed number: small postings make many sums
    blocks = max(1, ceil(sum(p.terms.count() for p in parts) / ASKED_ROWS))
    out = None
    for block in range(blocks):
        moved, asked = None, None
        for n, p in enumerate(parts):
            terms = p.terms.where(F.pmod(F.xxhash64(query), F.lit(blocks)) == block)
            number = (F.monotonically_increasing_id() * len(parts) + n).alias("_no")
            numbered = through_table(terms.dropDuplicates(["term"]).select("term", *p.shared, number), "asked-terms")
            rows = _postings(parts, p).join(F.broadcast(numbered), "term").select(F.col(p.index.doc).alias(doc), "_no", p.value.alias("_value"))
            wanted = terms.join(numbered.select("term", "_no"), "term").select(query, "_no", p.factor.alias("_factor"))
            moved, asked = (rows, wanted) if n == 0 else (moved.unionByName(rows), asked.unionByName(wanted))
        met = moved.repartition(tasks, doc).join(F.broadcast(asked), "_no")
        sums = met.groupBy(query, doc).agg(F.sum(F.col("_value") * F.col("_factor")).alias("score"))
        out = sums if out is None else out.unionByName(sums)
    return out


def bounded_search(parts: list[Scoring], query: str, doc: str, k: int) -> DataFrame:
    """Exact ``(query, document, score, rank)`` of the best ``k``, ties by id."""
    floored = _floored(parts, query, doc, k)
    if _bounds_help(floored, query):
        kept = through_table(_kept(floored, query, doc), "candidates")
        more = _looked_up(floored, kept, query, doc, F.col("_rest") < F.col("_floor"))
        scored = kept.select(query, doc, F.col("_s").alias("_gain")).unionByName(more)
        sums = _summed(scored, query, doc, "score")
    else:
        sums = _every_match(floored, query, doc)
    hits = best(sums, [query], doc, k)
    return hits if len(parts) > 1 else _beside_copies(hits, parts[0].index, query, doc, k)


def _beside_copies(hits: DataFrame, index: LexicalIndex, query: str, doc: str, k: int) -> DataFrame:
    """The best ``k`` of the hits and the documents alike, of which the smallest ``k - 1`` can enter."""
    few = top_k(index.copies, k - 1, [F.asc(index.doc)], ["_first"], "_no")
    lists = few.groupBy("_first").agg(F.collect_list(index.doc).alias("_more")).withColumnRenamed("_first", doc)
    ids = F.concat(F.array(doc), F.coalesce("_more", F.array().cast(dict(lists.dtypes)["_more"])))
    every = hits.join(lists, doc, "left").select(query, F.explode(ids).alias(doc), "score")
    return top_k(every, k, [F.desc("score"), F.asc(doc)], [query])


def best(scores: DataFrame, query: list[str], doc: str, k: int) -> DataFrame:
    """Top ``k`` per query by rounded score, ties by id: adds ``rank``."""
    rounded = scores.withColumn("score", F.round("score", SCORE_DIGITS)).where("score > 0")
    return top_k(rounded, k, [F.desc("score"), F.asc(doc)], query)

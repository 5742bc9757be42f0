"""Term-based and embedding-based retrieval for whole query tables.

Scores are rounded to nine decimals before they are ranked: a distributed sum
has no fixed order, and ties must fall to the smaller id, not to noise.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, FloatType

from ..functions import text as T
from ..functions import vectors as V
from ..functions.scalars import as_column
from ..functions.workers import made_once
from ..session import scratch_path
from .lexical import (
    SCORE_DIGITS,
    LexicalIndex,
    Scoring,
    append_documents,
    best,
    bm25_scoring,
    bounded_search,
    index_statistics,
    open_index,
    tfidf_scoring,
    write_index,
    write_word_index,
)
from .ordered import top_k

QUERY_BLOCK = 1024  # query vectors in one block
DOC_BLOCK = 4096  # document vectors in one block


def build_index(
    docs: DataFrame,
    doc: str,
    text: str | Column,
    analyzer: str = "word",
    ngrams: int = 1,
    min_df: int = 2,
    max_features: int | None = None,
) -> LexicalIndex:
    """An index in a new folder of the shared folder; ``write_index`` takes a path to keep it."""
    return write_index(docs, doc, text, scratch_path(docs.sparkSession, "index"), analyzer, ngrams, min_df, max_features)


def build_word_index(index: LexicalIndex) -> LexicalIndex:
    """The single words of an index of words and word pairs, in a new folder of the shared folder."""
    return write_word_index(index, scratch_path(index.docs.sparkSession, "index"))


def pad_with_zero(hits: DataFrame, queries: DataFrame, docs: DataFrame, query: str, doc: str, k: int) -> DataFrame:
    """Fill short result lists with the smallest unmatched ids at score zero.

    ``hits(query, doc, score, rank)`` are the top-``k`` matches. The first
    ``k`` ids suffice for any query, so the padding is one bounded array.
    """
    first = docs.select(doc).orderBy(doc).limit(k).agg(F.array_sort(F.collect_list(doc))).scalar()
    entry = F.struct(F.col(doc), F.col("score").cast("double").alias("score"), F.col("rank").cast("int").alias("rank"))
    found = hits.groupBy(query).agg(F.collect_list(entry).alias("_h"))  # at most k hits
    empty = F.array().cast(f"array<struct<{doc}:{dict(docs.dtypes)[doc]},score:double,rank:int>>")
    lists = queries.select(query).join(found, query, "left").select(query, F.coalesce("_h", empty).alias("_h"), first.alias("_first"))
    room = (F.lit(k) - F.size("_h")).cast("int")
    spare = F.slice(F.array_except("_first", F.transform("_h", lambda x: x[doc])), F.lit(1), room)
    pads = F.transform(
        spare, lambda d, i: F.struct(d.alias(doc), F.lit(0.0).alias("score"), (F.size("_h") + i + 1).cast("int").alias("rank"))
    )
    return lists.select(query, F.explode(F.concat("_h", pads)).alias("e")).select(query, "e.*")


def _search(parts: list[Scoring], queries: DataFrame, query: str, k: int, pad: bool) -> DataFrame:
    index = parts[0].index
    hits = bounded_search(parts, query, index.doc, k)
    return pad_with_zero(hits, queries, index.docs, query, index.doc, k) if pad else hits


def search_tfidf(index: LexicalIndex, queries: DataFrame, query: str, text: str, k: int = 100, pad: bool = True) -> DataFrame:
    """Cosine of unit-length TF-IDF vectors."""
    return _search([tfidf_scoring(index, queries, query, text)], queries, query, k, pad)


def search_bm25(
    index: LexicalIndex, queries: DataFrame, query: str, text: str, k: int = 100, k1: float = 1.5, b: float = 0.75, pad: bool = True
) -> DataFrame:
    return _search([bm25_scoring(index, queries, query, text, k1, b)], queries, query, k, pad)


def search_bm25_grid(index: LexicalIndex, queries: DataFrame, query: str, text: str, settings: list[tuple[float, float]], k: int = 100) -> DataFrame:
    """``(k1, b, query, document, score, rank)`` of every setting, in one job."""
    out = None
    for k1, b in settings:
        hits = search_bm25(index, queries, query, text, k, k1, b, pad=False)
        part = hits.select(F.lit(float(k1)).alias("k1"), F.lit(float(b)).alias("b"), query, index.doc, "score", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def search_combined(
    word: LexicalIndex, char: LexicalIndex, queries: DataFrame, query: str, text: str, k: int = 100, share: float = 0.6
) -> DataFrame:
    """``share`` of the word cosine plus the rest of the character cosine, summed before the cut."""
    parts = [tfidf_scoring(word, queries, query, text, share), tfidf_scoring(char, queries, query, text, 1 - share)]
    return _search(parts, queries, query, k, True)


# --- dense ---------------------------------------------------------------------------


def hashing_encoder(dimension: int) -> Callable:
    """Offline stand-in for a sentence model: words counted into digest buckets."""

    def make():
        import hashlib
        import re
        from functools import lru_cache

        pattern = re.compile(r"[^\W]{2,}")

        @lru_cache(maxsize=1 << 16)  # frequent words; the words of a corpus have no limit
        def place(word: str) -> int:
            return int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big") % dimension

        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), dimension))
            for i, value in enumerate(texts):
                words = pattern.findall(str(value).lower())
                if words:
                    out[i] = np.bincount(list(map(place, words)), minlength=dimension)
            return out

        return predict

    return make


def encode_texts(
    df: DataFrame, text: str, role: str, make_encoder: Callable, dimension: int, output: str = "embedding", batch: int = 256, allow_blank: bool = False
) -> DataFrame:
    """Unit vectors of role-prefixed texts from a caller-supplied batch model.

    A vector of the wrong size or with non-finite values stops the job, and so
    does a blank text, unless ``allow_blank`` has the prefix encoded for it. The
    model gets a null text as ``None``. A task holds ``batch`` texts as Python
    strings, whatever Spark hands over at once; the model is made once per
    Python worker.
    """
    key = uuid.uuid4().hex

    def unit(predict: Callable, texts: np.ndarray) -> pa.Array:
        vectors = np.asarray(predict(texts), dtype=np.float64)
        if vectors.shape != (len(texts), dimension) or not np.isfinite(vectors).all():
            raise ValueError("encoder returned a wrong shape or non-finite values")
        lengths = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
        flat = (vectors / np.where(lengths == 0, 1.0, lengths)).astype(np.float32).ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * dimension, pa.int32()), pa.array(flat))

    @F.arrow_udf(ArrayType(FloatType()))
    def encode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predict = made_once(key, make_encoder)
        for part in parts:
            for first in range(0, len(part), batch):
                yield unit(predict, np.array(part.slice(first, batch).to_pylist(), dtype=object))

    prefixed = F.concat(F.lit(f"{role}: "), F.col(text))
    stopped = F.when(F.trim(F.col(text)) == "", F.raise_error(F.lit("blank text cannot be encoded"))).otherwise(prefixed)
    checked = prefixed if allow_blank else stopped
    # declared nondeterministic, or a filter on the vectors would encode every text a second time below it
    return df.withColumn(output, encode.asNondeterministic()(checked))


def _packed(size: int):
    """Rows (id, vector) as blocks: one row with a list of ids and the vectors end to end; rows without a vector go."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            for first in range(0, len(batch), size):
                ids, vectors = batch.column(0).slice(first, size), batch.column(1).slice(first, size)
                flat = vectors.flatten().cast(pa.float64())
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays([one(ids), one(flat)], ["ids", "flat"])

    return run


def _blocks(df: DataFrame, key: str, vector: str, size: int, prefix: str) -> DataFrame:
    kind = dict(df.dtypes)[key]
    packed = df.select(key, vector).mapInArrow(_packed(size), f"ids array<{kind}>, flat array<double>")
    return packed.select(F.col("ids").alias(f"{prefix}_ids"), F.col("flat").alias(f"{prefix}_flat"))


def _best_of_blocks(k: int, query: str, doc: str, schema: pa.Schema):
    """The best ``k`` of each query among the document blocks that this task has seen with it."""

    def best_rows(scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row-wise the ``k`` largest scores, ties to the smaller id; rows are cut at the k-th value before they are sorted."""
        if scores.shape[1] > k:
            floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k, None]
            most = int((scores >= floor).sum(1).max())
            rank = np.argsort(-scores, axis=1, kind="stable")[:, :most]
            scores, ids = np.take_along_axis(scores, rank, 1), np.take_along_axis(ids, rank, 1)
        order = np.lexsort((ids, -scores), axis=1)[:, :k]
        return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)

    def emit(queries, held):
        scores, ids = held
        rows = np.repeat(np.arange(len(queries)), scores.shape[1])
        columns = [queries.take(pa.array(rows)), pa.array(ids.ravel()), pa.array(scores.ravel())]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], [f.name for f in schema])

    def run(batches):
        last, held, queries = None, None, None
        for batch in batches:
            for row in range(len(batch)):
                docs, mine = batch.column(0)[row].values, batch.column(2)[row].values
                if last is None or not mine.equals(last):
                    if held is not None:
                        yield emit(queries, held)
                    last, held, queries = mine, None, mine
                    matrix = batch.column(3)[row].values.to_numpy(zero_copy_only=False).reshape(len(mine), -1)
                block = batch.column(1)[row].values.to_numpy(zero_copy_only=False).reshape(len(docs), -1)
                scores = np.round(matrix @ block.T, SCORE_DIGITS)
                ids = np.broadcast_to(docs.to_numpy(zero_copy_only=False), scores.shape)
                fresh = best_rows(scores, ids)
                held = fresh if held is None else best_rows(*[np.concatenate(x, axis=1) for x in zip(held, fresh)])
        if held is not None:
            yield emit(queries, held)

    return run


def search_dense(
    docs: DataFrame, doc: str, vector: str, queries: DataFrame, query: str, query_vector: str, k: int = 100
) -> DataFrame:
    """Exact inner-product top ``k`` in one job, however many queries there are.

    Vectors are packed into blocks inside the tasks. Every block of the stated
    queries meets every block of documents once; the product of two blocks is
    one matrix product, of which a task keeps the best ``k`` per query. Rows
    without a vector are left out.
    """
    schema = f"{query} {dict(queries.dtypes)[query]}, {doc} {dict(docs.dtypes)[doc]}, score double"
    blocks = _blocks(docs, doc, vector, DOC_BLOCK, "doc")
    asked = _blocks(queries.repartition(F.col(query)), query, query_vector, QUERY_BLOCK, "query")
    spark = docs.sparkSession
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    near = blocks.crossJoin(asked).mapInArrow(_best_of_blocks(k, query, doc, arrow), schema)
    return top_k(near, k, [F.desc("score"), F.asc(doc)], [query])


def search_dense_approximate(
    docs: DataFrame,
    doc: str,
    vector: str,
    queries: DataFrame,
    query: str,
    query_vector: str,
    k: int = 100,
    tables: int = 24,
    hashes: int = 3,
    bucket: float = 0.3,
    seed: int = 42,
) -> DataFrame:
    """Top ``k`` by inner product among the unit vectors that share a table entry with the query.

    A table entry is ``hashes`` bucketed random projections together. Documents
    and queries meet by entry, so work follows the matches; pairs are scored in
    full. Measure the recall on your vectors (``recall_of``).
    """
    lsh = BucketedRandomProjectionLSH(inputCol="_v", outputCol="_h", bucketLength=bucket, numHashTables=tables * hashes, seed=seed)

    def prepared(df: DataFrame, key: str, column: str) -> DataFrame:
        return df.where(F.col(column).isNotNull()).select(key, F.transform(column, lambda x: x.cast("double")).alias("_x"), array_to_vector(column).alias("_v"))

    left, right = prepared(docs, doc, vector), prepared(queries, query, query_vector)
    model = lsh.fit(left)

    def entries(df: DataFrame, key: str) -> DataFrame:
        hashed = model.transform(df).select(key, F.transform("_h", lambda h: vector_to_array(h)[0].cast("int")).alias("_h"))
        own = F.array(*[F.xxhash64(F.lit(n), *[F.get("_h", F.lit(n * hashes + i)) for i in range(hashes)]) for n in range(tables)])
        return hashed.select(key, F.explode(own).alias("_entry"))

    met = entries(right, query).join(entries(left, doc), "_entry").select(query, doc).distinct()
    scored = met.join(left.select(doc, "_x"), doc).join(right.select(query, F.col("_x").alias("_y")), query)
    scores = scored.select(query, doc, F.round(V.dot("_x", "_y"), SCORE_DIGITS).alias("score"))
    return top_k(scores, k, [F.desc("score"), F.asc(doc)], [query])


def recall_of(found: DataFrame, exact: DataFrame, query: str, doc: str) -> DataFrame:
    """One row: wanted, found and their ratio."""
    both = exact.select(query, doc).join(found.select(query, doc, F.lit(1).alias("_hit")), [query, doc], "left")
    return both.agg(F.count(F.lit(1)).alias("wanted"), F.count("_hit").alias("found")).withColumn("recall", F.round(F.col("found") / F.col("wanted"), 6))


def class_centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Unit mean vector per label, averaged dimension by dimension."""
    parts = df.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = parts.groupBy(label).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m")  # one entry per dimension
    )
    return means.select(label, F.transform("m", lambda x: x / V.norm("m")).alias("centroid"))


def filter_results(results: DataFrame, catalogue: DataFrame, query: str | list[str], doc: str, filters: dict[str, str], k: int) -> DataFrame:
    """Equality filters on a retrieved pool, then ranks 1..k again per query (one or several key columns)."""
    wanted = catalogue
    for column, value in filters.items():
        wanted = wanted.where(F.col(column) == value)
    kept = results.drop("rank").join(wanted.select(doc, *filters), doc)
    return top_k(kept, k, [F.desc("score"), F.asc(doc)], [query] if isinstance(query, str) else query)


def overlap_signal(results: DataFrame, query_text: str, title: str) -> DataFrame:
    """Number of shared lower-case words of query and title per hit."""
    shared = T.overlap_size(T.word_set(F.lower(as_column(query_text))), T.word_set(F.lower(as_column(title))))
    return results.withColumn("shared_tokens", shared)


__all__ = [
    "LexicalIndex", "append_documents", "best", "bounded_search", "build_index", "build_word_index", "class_centroids", "encode_texts",
    "filter_results", "hashing_encoder", "index_statistics", "open_index", "overlap_signal", "pad_with_zero", "recall_of", "search_bm25",
    "search_bm25_grid", "search_combined", "search_dense", "search_dense_approximate", "search_tfidf", "write_index", "write_word_index",
]

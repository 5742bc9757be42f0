"""Vector codes from codebooks that are searched by slice-and-intersect bitmasks.

A vector is cut into ``parts`` equal pieces; each piece is coded by the nearest
of up to 256 entries of its part's codebook. For every dimension the entries
are sorted by their coordinate, and the mask at place i holds the first i of
them, one bit per entry. The entries whose coordinate lies within a radius of a
query are then two binary searches and one XOR of prefix masks; the AND over
all dimensions gives exactly the entries inside the cube around the query.

The radius starts at a quarter of the mean spread of the entries. If the best
entry of the cube is no farther than the radius, nothing outside can be nearer.
Otherwise the search is repeated with that entry's distance, rounded up, as
radius, which is final; an empty cube doubles the radius. So every answer is
exact, ties going to the lower index.

Rounds work as in ``clusters``: tasks add up, totals are shuffled, and the
codebooks (``parts`` x 256 x width numbers) travel with the tasks.

Null vectors and vectors with null, non-finite or out-of-range components
(65,536 or more in size) are left out. The length is that of the usable vector
with the smallest id; it must be a positive multiple of ``parts``, and vectors
of other lengths, or all if it is not, are left out. Rows without an id are
coded but start no entry; rows that share an id are ordered by components.
Repeated rows count each time. With fewer than 256 vectors there are fewer
entries. Null labels are one label. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import through_table
from .whole_vectors import Sums, matrix, moved, usable, whole

PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Pieces searched together; with 256 entries of 16 numbers, 8 MB.
TOGETHER = 256


class Sliced:
    """Exact nearest entries of one codebook."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        size, width = entries.shape
        self.words = -(-size // 64)
        own = np.zeros((size, self.words), np.uint64)
        own[np.arange(size), np.arange(size) // 64] = np.uint64(1) << (np.arange(size) % 64).astype(np.uint64)
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, 0)
        self.prefix = np.zeros((width, size + 1, self.words), np.uint64)
        for j in range(width):
            np.bitwise_or.accumulate(own[order[:, j]], axis=0, out=self.prefix[j, 1:])
        self.radius = max(1, int(entries.std(axis=0).mean() / 4))

    def inside(self, pieces: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries within ``radius`` of each piece in every dimension."""
        mask = np.full((len(pieces), self.words), ~np.uint64(0))
        for j in range(pieces.shape[1]):
            low = np.searchsorted(self.sorted[:, j], pieces[:, j] - radius, side="left")
            high = np.searchsorted(self.sorted[:, j], pieces[:, j] + radius, side="right")
            mask &= self.prefix[j, high] ^ self.prefix[j, low]
        return mask

    def nearest(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of every piece."""
        index, best = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        radius = np.full(len(pieces), self.radius, np.int64)
        todo = np.arange(len(pieces))
        while len(todo):
            mask = self.inside(pieces[todo], radius[todo])
            bits = np.unpackbits(mask.view(np.uint8), axis=1, bitorder="little")
            row, entry = np.nonzero(bits)
            found, start = np.unique(row, return_index=True)
            some = np.zeros(len(todo), bool)
            some[found] = True
            radius[todo[~some]] *= 2
            if len(found):
                distance = ((pieces[todo[row]] - self.entries[entry]) ** 2).sum(1)
                least = np.minimum.reduceat(distance, start)
                tied = distance == np.repeat(least, np.diff([*start, len(row)]))
                at = todo[found]
                index[at] = np.minimum.reduceat(np.where(tied, entry, len(self.entries)), start)
                best[at] = least
                radius[at[least > radius[at] ** 2]] = -1  # to be repeated
                certain = np.zeros(len(todo), bool)
                certain[found] = radius[at] >= 0
                again = at[radius[at] < 0]
                root = np.sqrt(best[again].astype(np.float64)).astype(np.int64)
                radius[again] = root + 2  # never below the distance, whatever the rounding
                todo = todo[~certain]
        return index, best


def _pieces(batch: pa.RecordBatch, column: int, parts: int, width: int):
    """(first row, pieces by part) of bounded slices of a batch."""
    for first in range(0, batch.num_rows, TOGETHER):
        rows = matrix(batch.column(column).slice(first, TOGETHER), width)
        yield first, rows.reshape(len(rows), parts, width // parts)


def _add_up(books: np.ndarray):
    parts, size, piece = books.shape

    def run(batches):
        search, sums = [Sliced(b) for b in books], Sums(parts * size, piece)
        for batch in batches:
            for _, pieces in _pieces(batch, 0, parts, parts * piece):
                for p in range(parts):
                    index, _ = search[p].nearest(pieces[:, p])
                    sums.add(p * size + index, pieces[:, p])
        yield sums.batch()

    return run


def _encode(books: np.ndarray):
    parts, _, piece = books.shape

    def run(batches):
        search = [Sliced(b) for b in books]
        for batch in batches:
            for first, pieces in _pieces(batch, 2, parts, parts * piece):
                found = [search[p].nearest(pieces[:, p]) for p in range(parts)]
                codes = np.stack([index for index, _ in found], 1).astype(np.uint8)
                rows = len(codes)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, rows),
                        batch.column(1).slice(first, rows),
                        pa.array([c.tobytes().hex() for c in codes]),
                        pa.array(sum(distance for _, distance in found)),
                    ],
                    ["id", "label", "code", "error"],
                )

    return run


def encode(
    df: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> tuple[DataFrame, np.ndarray]:
    """(``id, label, code, error`` of every usable vector, codebooks by part, entry and position); at most 256 entries."""
    spark, kind = df.sparkSession, df.schema[label_col].dataType.simpleString()
    kept = df.where(usable(F.col(vector_col)) & (F.size(vector_col) > 0))
    vectors = through_table(
        kept.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), whole(F.col(vector_col)).alias("v")), "vectors"
    )
    first = vectors.where("id is not null").orderBy("id", "v").select("v")
    head = first.limit(1).collect()
    schema = f"id long, label {kind}, code string, error long"
    width = len(head[0]["v"]) if head else 0
    if not width or width % parts:
        return spark.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    vectors = vectors.where(F.size("v") == width)
    seeds = np.array([r["v"] for r in first.where(F.size("v") == width).limit(entries).collect()], np.int64)
    size, piece = len(seeds), width // parts
    books = np.ascontiguousarray(seeds.reshape(size, parts, piece).transpose(1, 0, 2))
    for _ in range(rounds):
        flat = moved(vectors.select("v").mapInArrow(_add_up(books), Sums.SCHEMA), books.reshape(parts * size, piece))
        books = flat.reshape(parts, size, piece)
    return through_table(vectors.select("id", "label", "v").mapInArrow(_encode(books), schema), "codes"), books


def with_label_errors(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """Add ``label_error`` and ``codebooks_sha256``; labels are added up before they meet their rows."""
    totals = coded.groupBy(F.col("label").alias("other")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return coded.join(totals, F.col("label").eqNullSafe(F.col("other")), "left").drop("other").withColumn("codebooks_sha256", F.lit(digest))


def op13_vector_codes(spark, folder: str) -> DataFrame:
    coded, books = encode(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return with_label_errors(coded, books).select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")

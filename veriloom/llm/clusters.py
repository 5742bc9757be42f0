"""Centroid clustering whose assignments are found by Orchard's search.

Every centroid has the list of the others, nearest first. The search for a
vector starts at one centroid and walks its list; a centroid that is closer
(or as close, with a smaller number) is jumped to at once and its own list is
walked from the start. What has been measured is marked and not measured again.
The walk ends where the list is strictly farther from the current centroid than
twice the current distance: by the triangle inequality all beyond is strictly
farther from the vector, so ties are still seen and the result is exact.

All numbers are integers (see ``whole_vectors``). A round is one pass over the
stored vectors: tasks add up their rows by centroid, and only these totals are
shuffled. The centroids, ``k`` times ``width`` numbers, travel with the tasks.
A lost executor repeats its tasks of one round.

Null vectors, other lengths, and null, non-finite or out-of-range components
(65,536 or more in size) are left out. Repeated rows count each time. Rows
without an id are clustered but start no centroid; of rows that share an id,
each may start one, ordered by their components. With fewer vectors than
centroids, there are fewer centroids. Columns of other names are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import through_table
from .whole_vectors import Sums, matrix, moved, usable, whole

WIDTH = 64
K = 8
ROUNDS = 10
SEED = "3"
#: Vectors searched together; bounds the memory of a task.
TOGETHER = 4096


class Orchard:
    """Nearest centroids of many vectors, all searches taking their next step together."""

    def __init__(self, centers: np.ndarray) -> None:
        self.centers = centers
        apart = ((centers[:, None, :] - centers[None, :, :]) ** 2).sum(2)
        self.lists = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.lists, 1)

    def nearest(self, vectors: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of every row."""
        m, k = len(vectors), len(self.centers)
        now = np.zeros(m, np.int64) if start is None else start.copy()
        best = ((vectors - self.centers[now]) ** 2).sum(1)
        seen = np.zeros((m, k), bool)
        seen[np.arange(m), now] = True
        at = np.zeros(m, np.int64)
        walking = np.arange(m)
        while len(walking):
            here, place = now[walking], at[walking]
            on = place < k
            on[on] = self.apart[here[on], place[on]] <= 4 * best[walking[on]]
            walking, here, place = walking[on], here[on], place[on]
            at[walking] += 1
            other = self.lists[here, place]
            fresh = ~seen[walking, other]
            rows, other = walking[fresh], other[fresh]
            seen[rows, other] = True
            distance = ((vectors[rows] - self.centers[other]) ** 2).sum(1)
            closer = (distance < best[rows]) | ((distance == best[rows]) & (other < now[rows]))
            rows = rows[closer]
            now[rows], best[rows], at[rows] = other[closer], distance[closer], 0
        return now, best


def _walks(search: Orchard, batch: pa.RecordBatch, column: int):
    """(first row, vectors, numbers, squared distances) of bounded pieces of a batch."""
    width = search.centers.shape[1]
    for first in range(0, batch.num_rows, TOGETHER):
        vectors = matrix(batch.column(column).slice(first, TOGETHER), width)
        yield first, vectors, *search.nearest(vectors)


def _add_up(centers: np.ndarray):
    def run(batches):
        search, sums = Orchard(centers), Sums(*centers.shape)
        for batch in batches:
            for _, vectors, number, _ in _walks(search, batch, 0):
                sums.add(number, vectors)
        yield sums.batch()

    return run


def _assign(centers: np.ndarray):
    def run(batches):
        search = Orchard(centers)
        for batch in batches:
            for first, vectors, number, distance in _walks(search, batch, 1):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(vectors)), pa.array(number, pa.int32()), pa.array(distance)], ["id", "cluster", "distance"]
                )

    return run


def first_centers(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors with the smallest digests of seed and id, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.where("id is not null").orderBy(digest, "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in rows], np.int64)


def cluster(
    df: DataFrame,
    k: int = K,
    rounds: int = ROUNDS,
    width: int = WIDTH,
    seed: str = SEED,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """(``id, cluster, distance`` of every usable vector, final centroids)."""
    spark = df.sparkSession
    kept = df.where(usable(F.col(vector_col)) & (F.size(vector_col) == width))
    vectors = through_table(kept.select(F.col(id_col).cast("long").alias("id"), whole(F.col(vector_col)).alias("v")), "vectors")
    centers = first_centers(vectors, k, seed)
    schema = "id long, cluster int, distance long"
    if not len(centers):
        return spark.createDataFrame([], schema), centers.reshape(0, width)
    for _ in range(rounds):
        centers = moved(vectors.select("v").mapInArrow(_add_up(centers), Sums.SCHEMA), centers)
    return through_table(vectors.select("id", "v").mapInArrow(_assign(centers), schema), "assigned"), centers


def with_inertia(assigned: DataFrame, centers: np.ndarray) -> DataFrame:
    """Add the inertia of the cluster and of all, and the digest of the centroid; one row per centroid is broadcast."""
    spark = assigned.sparkSession
    digests = [(n, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for n, c in enumerate(centers.tolist())]
    own = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [(n, own.get(n, 0), sum(own.values()), d) for n, d in digests]
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster")


def op12_orchard_clusters(spark, folder: str) -> DataFrame:
    assigned, centers = cluster(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return with_inertia(assigned, centers).select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )

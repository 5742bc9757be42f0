"""Balanced sharding by longest-processing-time scheduling.

Documents with equal text form a group and stay together. Groups, heaviest
first, go to the shard with the least bytes, kept in a heap.

The scheduler never sees more than a bounded list. A group that holds at least
``1 / (heavy * shards)`` of all bytes is an item of its own, and there are at
most ``heavy * shards`` of those. All others are added up by the first four
digits of their digest into at most 65,536 items. Both lists are counted by
Spark with partial sums, so a group of any size costs one row per task.

Slots are numbered without gaps inside a shard from block counts and row
numbers inside small hash blocks; no shard is ever sorted as a whole.

Null text counts as empty. Repeated rows are separate rows of one group. An
empty table gives an empty result. Columns named like a result are replaced.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import text_of, without

RESULT = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
BLOCK_ROWS = 20_000
PREFIX = 4


def schedule(items: list[tuple[str, int]], shards: int) -> list[tuple[str, int]]:
    """Heaviest item first, each to the least-loaded shard; ties fall to the smaller name and shard."""
    heap = [(0, s) for s in range(shards)]
    placed = []
    for name, size in sorted(items, key=lambda i: (-i[1], i[0])):
        load, shard = heapq.heappop(heap)
        placed.append((name, shard))
        heapq.heappush(heap, (load + size, shard))
    return placed


def shard_documents(docs: DataFrame, shards: int = 8, heavy: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``size, text_crc32, law, shard, slot, grown_shard`` appended."""
    spark = docs.sparkSession
    text = text_of(text_col)
    base = without(docs, RESULT)
    rows = base.select(
        "*",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.md5(text.cast("binary")).alias("__v_digest"),
    )
    groups = rows.groupBy("__v_digest").agg(F.sum("size").alias("bytes"))
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    cut = max(1, total // (heavy * shards))
    alone = F.col("bytes") >= cut
    items = groups.select(
        F.when(alone, F.col("__v_digest")).otherwise(F.substring("__v_digest", 1, PREFIX)).alias("name"), "bytes"
    )
    # At most 16 ** PREFIX + heavy * shards rows, whatever the input.
    summed = items.groupBy("name").agg(F.sum("bytes").alias("bytes")).collect()
    placed = schedule([(r["name"], r["bytes"]) for r in summed], shards)
    whole = spark.createDataFrame([p for p in placed if len(p[0]) > PREFIX], "__v_digest string, __v_own int")
    light = spark.createDataFrame([p for p in placed if len(p[0]) <= PREFIX], "__v_prefix string, __v_common int")
    blocks = max(1, -(-count // (BLOCK_ROWS * shards)))
    put = (
        rows.withColumn("__v_prefix", F.substring("__v_digest", 1, PREFIX))
        .join(F.broadcast(whole), "__v_digest", "left")
        .join(F.broadcast(light), "__v_prefix", "left")
        .withColumn("shard", F.coalesce("__v_own", "__v_common"))
        .withColumn("__v_block", F.pmod(F.xxhash64(F.col(id_col), F.col("__v_digest")), F.lit(blocks)).cast("int"))
        .drop("__v_prefix", "__v_own", "__v_common")
    )
    before = Window.partitionBy("shard").orderBy("__v_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        put.groupBy("shard", "__v_block")
        .agg(F.count("*").alias("n"))
        .select("shard", "__v_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__v_offset"))
    )
    inside = Window.partitionBy("shard", "__v_block").orderBy(F.col(id_col), F.col("__v_digest"))
    return (
        put.withColumn("__v_row", F.row_number().over(inside))
        .join(offsets, ["shard", "__v_block"])
        .select(
            *[F.col(f"`{c}`") for c in base.columns],
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("__v_offset") + F.col("__v_row") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op6_sharding(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return shard_documents(docs).select("doc_id", *RESULT)

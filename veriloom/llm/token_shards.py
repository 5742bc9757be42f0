"""Token ids in training order: fixed-stride binary records behind a keyed permutation.

Texts are encoded, ended by the end mark, and cut into sequences of ``length``
ids, the last one padded. Sequences get dense numbers: documents are dealt to
blocks by a digest of their id, and numbered from block totals and running sums
inside the small blocks. A keyed Feistel network over the next even number of
bits, walked along its cycle until the value is below the count, permutes the
numbers to global slots: any slot can be computed, or inverted, without a table.

Shard s holds slots ``s * rows`` to ``(s + 1) * rows - 1`` in order, each a
record of ``length * width`` bytes. A reader finds slot k at byte
``(k mod rows) * stride`` of shard ``k div rows`` and resumes from a slot number
alone. Shard numbers are partition numbers of one range exchange, so every shard
is written by one task of fixed size, whatever the data.

Encoded sequences are written once, unpadded, to the shared folder. Document
numbers are broadcast up to ``BROADCAST_ROWS`` rows, else both sides are
shuffled by document.

Null text is empty; an empty text is one sequence of an end mark and padding.
Repeated rows are encoded and numbered one by one; rows with equal ids follow
each other. Null ids sort first in their block. An empty table gives an empty
result. Extra columns are not carried.
"""

from __future__ import annotations

import base64
import posixpath
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

LENGTH = 1024
ROWS = 8192
BLOCK_DOCS = 20_000
BROADCAST_ROWS = 1_000_000
ROUNDS = 8
# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_U = np.uint64


def encoder(path: str):
    """A tiktoken encoding from a file of base64 pieces and ranks, and its first free id as end mark."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(posixpath.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


def _round(value: np.ndarray, key: int, r: int) -> np.ndarray:
    x = value + _U((key + r * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _network(value: np.ndarray, half: int, key: int, rounds) -> np.ndarray:
    mask = _U((1 << half) - 1)
    left, right = value >> _U(half), value & mask
    for r in rounds:
        left, right = right, left ^ (_round(right, key, r) & mask)
    return (right << _U(half)) | left


def permute(index: np.ndarray, count: int, key: int, back: bool = False) -> np.ndarray:
    """Slot of every number below ``count``, or with ``back`` the number of every slot."""
    half = max(1, (max(count - 1, 1).bit_length() + 1) // 2)
    rounds = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    out = _network(index.astype(_U), half, key, rounds)
    while (high := out >= _U(count)).any():
        out[high] = _network(out[high], half, key, rounds)
    return out.astype(np.int64)


def _encode_pass(path: str, length: int):
    def run(batches):
        encode, end = None, 0
        task, row = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
        for batch in batches:
            if encode is None:
                made, end = encoder(path)
                encode = made.encode_ordinary
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for begin in range(0, len(ids), 256):
                out = [[], [], [], [], [], []]
                for i, text in zip(ids[begin : begin + 256], texts[begin : begin + 256]):
                    tokens = np.array(encode(text) + [end], np.uint32 if end > 0xFFFF else np.uint16)
                    parts = -(-len(tokens) // length)
                    for k in range(parts):
                        own = tokens[k * length : (k + 1) * length]
                        for c, v in zip(out, ((task << 36) + row, i, k, parts, len(own), own.tobytes())):
                            c.append(v)
                    row += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))],
                    ["uid", "doc_id", "seq_no", "parts", "n_tokens", "data"],
                )

    return run


ENCODED = "uid long, doc_id long, seq_no int, parts int, n_tokens int, data binary"


def token_shards(
    docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, rows: int = ROWS, key: int = 11, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``shard, row, slot, number, doc_id, seq_no, n_tokens, record``, one partition per shard, in slot order."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    path = scratch_path(spark, "tokens")
    # Written once: from here on, a row's uid never changes.
    texts.mapInArrow(_encode_pass(vocabulary, length), ENCODED).write.option("compression", "zstd").parquet(path)
    encoded = spark.read.schema(ENCODED).parquet(path)

    heads = encoded.where("seq_no = 0").select("uid", "doc_id", "parts")
    n_docs, count = heads.agg(F.count("*"), F.coalesce(F.sum("parts"), F.lit(0))).first()
    blocks = max(1, -(-n_docs // BLOCK_DOCS))
    dealt = heads.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # over one row per block
    starts = dealt.groupBy("block").agg(F.sum("parts").alias("n")).select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("block").orderBy("doc_id", "uid").rowsBetween(Window.unboundedPreceding, -1)
    numbered = (
        dealt.withColumn("own", F.coalesce(F.sum("parts").over(inside), F.lit(0)))
        .join(F.broadcast(starts), "block")
        .select("uid", (F.col("start") + F.col("own")).alias("first"))
    )
    if n_docs <= BROADCAST_ROWS:
        numbered = F.broadcast(numbered)

    @F.pandas_udf("long")
    def slot_of(number: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(), count, key))

    width = 4 if _wide(vocabulary) else 2
    slotted = (
        encoded.join(numbered, "uid")
        .withColumn("number", F.col("first") + F.col("seq_no"))
        .withColumn("slot", slot_of("number"))
        .withColumn("shard", F.floor(F.col("slot") / rows).cast("int"))
    )
    # The pad id is the end mark, as little-endian bytes.
    end = _end_of(vocabulary).to_bytes(width, "little").hex()
    record = F.rpad("data", length * width, F.unhex(F.lit(end)))
    return (
        slotted.select("shard", (F.col("slot") % rows).cast("int").alias("row"), "slot", "number", "doc_id", "seq_no", "n_tokens", "data")
        .repartitionById(max(1, -(-count // rows)), F.col("shard"))
        .sortWithinPartitions("slot")
        .withColumn("record", record)
        .drop("data")
    )


def _end_of(vocabulary: str) -> int:
    with open(vocabulary, "rb") as lines:
        return max(int(line.split()[1]) for line in lines if line.strip()) + 1


def _wide(vocabulary: str) -> bool:
    return _end_of(vocabulary) > 0xFFFF


def write_files(shards: DataFrame, folder: str) -> DataFrame:
    """Write ``shards`` as ``folder/shard-00000.bin`` and report ``shard, rows, bytes``.

    ``folder`` is any address that pyarrow opens from every executor. A task
    writes under a name of its own and renames at the end, so a repeated or a
    parallel attempt replaces a file by an equal one and a reader never sees a
    part of one.
    """

    def run(batches):
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        shard, out, name, rows, size = None, None, "", 0, 0

        def done():
            out.close()
            store.move(name, f"{top}/shard-{shard:05d}.bin")
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "rows": pa.array([rows], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for batch in batches:
            for s, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if s != shard:
                    if out is not None:
                        yield done()
                    shard, name, rows, size = s, f"{top}/.{uuid.uuid4().hex}", 0, 0
                    out = store.open_output_stream(name)
                out.write(record)
                rows, size = rows + 1, size + len(record)
        if out is not None:
            yield done()

    return shards.select("shard", "record").mapInArrow(run, "shard int, rows long, bytes long")


def op2_token_shards(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return token_shards(docs)

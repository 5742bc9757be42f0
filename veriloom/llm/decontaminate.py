"""Benchmark decontamination with an FM-index per shard.

The test phrases are all runs of ``window`` words of the benchmark items; an
item with fewer words is one phrase. A shard is a run of documents of one task.
Its words become numbers (0: not in the benchmark) and keep only stretches that
a phrase could lie in, judged by pairs of neighbouring words. Over these the
task builds an FM-index: all phrases are searched backwards at once through the
ranks of a wavelet matrix, and every occurrence is located from sampled suffix
positions. Overlapping occurrences merge to spans of document words.

The benchmark is split into blocks of about ``BLOCK_WORDS`` words; only one
block at a time is collected, but the driver keeps every encoded block in the
plan, and a task holds one per step. Documents pass the blocks one after the other in the same stage: there is
no shuffle, no join and no group.

Null and empty texts, and items without words, have no words and no hits.
Repeated rows are searched alike; items with one id count once. Items without an
id are searched too and count once together, as a null in ``items``. An empty
benchmark leaves everything clean; an empty table gives an empty result.
Columns named like a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from .columns import without
from .fm_index import FMIndex
from .shingling import LOWER, NON_WORD, chunks, slices, word_spans, words

WINDOW = 10
BLOCK_WORDS = 1_000_000
#: Words of one index; a batch with more stretches of possible phrases has several, one after the other.
SHARD_WORDS = 200_000
_PAIR_BITS = 22
RESULT = ["n_words", "n_hit", "items", "contaminated", "spans", "clean_text"]
_SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32())])


class Phrases:
    """One block of the benchmark: vocabulary, phrases by length and the items of each phrase."""

    def __init__(self, rows: list[tuple[str | None, str]], window: int):
        texts = pa.array([t for _, t in rows], pa.string())
        ids = [i for i, _ in rows]
        seen: dict[bytes, set[str | None]] = {}
        all_words = []
        for first_row, data, offsets in chunks(texts):
            digest, first = words(data, offsets, NON_WORD)
            for i in range(len(offsets) - 1):
                own = digest[first[i] : first[i + 1]]
                if not len(own):
                    continue
                all_words.append(own)
                size = min(window, len(own))
                for k in range(len(own) - size + 1):
                    seen.setdefault(own[k : k + size].tobytes(), set()).add(ids[first_row + i])
        self.vocabulary = np.unique(np.concatenate(all_words)) if all_words else np.zeros(0, np.uint64)
        self.pairs = np.zeros(1 << _PAIR_BITS, bool)
        self.single = np.zeros(len(self.vocabulary) + 1, bool)
        self.by_length: dict[int, tuple[np.ndarray, list[list[str]]]] = {}
        grouped: dict[int, list[tuple[bytes, set[str]]]] = {}
        for raw, items in seen.items():
            grouped.setdefault(len(raw) // 8, []).append((raw, items))
        for size, found in grouped.items():
            table = self.number(np.frombuffer(b"".join(raw for raw, _ in found), np.uint64)).reshape(-1, size)
            self.by_length[size] = (table, [_sorted(items) for _, items in found])
            if size == 1:
                self.single[table[:, 0]] = True
            else:
                self.pairs[self.pair(table[:, :-1], table[:, 1:]).ravel()] = True
        self.shortest = min(grouped, default=0)

    def number(self, digests: np.ndarray) -> np.ndarray:
        """1-based numbers of words of the vocabulary, 0 for others."""
        if not len(self.vocabulary):
            return np.zeros(len(digests), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, digests), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == digests, at + 1, 0)

    @staticmethod
    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * 2654435761) ^ (b * 40503)) & ((1 << _PAIR_BITS) - 1)

    def live(self, number: np.ndarray, text_start: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of word places that can hold a phrase."""
        n = len(number)
        if not n or not self.shortest:
            return []
        joined = np.zeros(n, bool)  # this word continues the one before
        joined[1:] = (number[:-1] > 0) & (number[1:] > 0) & self.pairs[self.pair(number[:-1], number[1:])]
        joined[text_start[text_start < n]] = False
        used = joined.copy()
        used[:-1] |= joined[1:]
        used |= self.single[number]
        begin = np.flatnonzero(used & ~joined)
        end = np.ones(n, bool)
        end[:-1] = ~joined[1:]
        stop = np.flatnonzero(used & end) + 1
        keep = stop - begin >= self.shortest
        return list(zip(begin[keep], stop[keep]))

    def occurrences(self, stretches: list[np.ndarray], places: list[np.ndarray]):
        """(word place, length, items of the phrase) for everything found in the shard."""
        gap = np.zeros(1, np.int64)
        parts, where = [], []
        for s, p in zip(stretches, places):
            parts += [s, gap]
            where += [p, gap - 1]
        place = np.concatenate(where)
        index = FMIndex(np.concatenate(parts), len(self.vocabulary) + 1)
        for size, (table, items) in self.by_length.items():
            low, high = index.search(table)
            count = high - low
            hit = np.flatnonzero(count)
            if not len(hit):
                continue
            phrase = np.repeat(hit, count[hit])
            first = np.cumsum(count[hit]) - count[hit]
            rows = np.arange(len(phrase)) - np.repeat(first, count[hit]) + low[phrase]
            yield place[index.locate(rows)], size, phrase, items


def _sorted(items) -> list[str | None]:
    """Ids in order; null, for items without one, comes last."""
    return sorted(items, key=lambda i: (i is None, i or ""))


def _shards(stretches: list[np.ndarray], places: list[np.ndarray]):
    """Runs of stretches with about ``SHARD_WORDS`` words, or one longer stretch."""
    first, size = 0, 0
    for k, s in enumerate(stretches):
        if size and size + len(s) > SHARD_WORDS:
            yield stretches[first:k], places[first:k]
            first, size = k, 0
        size += len(s)
    if size:
        yield stretches[first:], places[first:]


def _search(phrases: Phrases, names: list[str]):
    """Add the block's spans (word numbers) and items to the last two columns; the third last is the text."""

    def run(batches):
        for batch in batches:
            spans = batch.column(batch.num_columns - 2).to_pylist()
            items = batch.column(batch.num_columns - 1).to_pylist()
            stretches, places, starts, base = [], [], [], 0
            for _, data, offsets in chunks(batch.column(batch.num_columns - 3)):
                digest, first = words(data, offsets, NON_WORD)
                number = phrases.number(digest)
                for a, b in phrases.live(number, first[:-1]):
                    stretches.append(number[a:b])
                    places.append(np.arange(a, b) + base)
                starts.append(first[:-1] + base)
                base += len(digest)
            start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
            for own, at in _shards(stretches, places):
                for place, size, phrase, owners in phrases.occurrences(own, at):
                    # The last text that starts at or before the word; texts without words share a start.
                    text = np.searchsorted(start, place, side="right") - 1
                    inside = place - start[text]
                    for t, p in set(zip(text.tolist(), phrase.tolist())):
                        items[t] = _sorted({*(items[t] or ()), *owners[p]})
                    order = np.lexsort((inside, text))
                    t, s = text[order], inside[order]
                    # Touching or overlapping occurrences of one text become one span.
                    new = np.ones(len(t), bool)
                    new[1:] = (t[1:] != t[:-1]) | (s[1:] > s[:-1] + size)
                    at = np.flatnonzero(new)
                    stop = s[np.r_[at[1:] - 1, len(s) - 1]] + size
                    for row, a, b in zip(t[at].tolist(), s[at].tolist(), stop.tolist()):
                        spans[row] = [*(spans[row] or ()), {"start": a, "stop": b}]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(spans, pa.list_(_SPAN)), pa.array(items, pa.list_(pa.string()))], names
            )

    return run


def _merge(names: list[str]):
    """Replace text, spans and items by the result columns."""

    def run(batches):
        for batch in slices(batches):
            text_at = batch.num_columns - 3
            spans = batch.column(text_at + 1).to_pylist()
            out: list[list] = [[] for _ in RESULT]
            for row, data, offsets in chunks(batch.column(text_at)):
                start, _, first = word_spans(LOWER[data], offsets, NON_WORD)
                for i in range(len(offsets) - 1):
                    a, b = int(first[i]), int(first[i + 1])
                    text = data[offsets[i] : offsets[i + 1]]
                    merged: list[list[int]] = []
                    for s in sorted((x["start"], x["stop"]) for x in spans[row + i] or ()):
                        if merged and s[0] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], s[1])
                        else:
                            merged.append(list(s))
                    keep = np.ones(len(text), bool)
                    for s, e in merged:
                        begin = start[a + s] - offsets[i]
                        end = start[a + e] - offsets[i] if a + e < b else len(text)
                        keep[begin:end] = False
                    hit = sum(e - s for s, e in merged)
                    own = batch.column(text_at + 2)[row + i].as_py() or []
                    clean = text[keep].tobytes().decode("utf-8", "replace") if merged else text.tobytes().decode("utf-8", "replace")
                    for c, v in zip(out, (b - a, hit, own, hit > 0, [{"start": s, "stop": e} for s, e in merged], clean)):
                        c.append(v)
            types = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.bool_(), pa.list_(_SPAN), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:text_at], *[pa.array(c, t) for c, t in zip(out, types)]], [*names, *RESULT]
            )

    return run


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, text_col: str = "text"
) -> DataFrame:
    """``docs`` with ``n_words, n_hit, items, contaminated, spans`` (of words) and ``clean_text`` appended."""
    base = without(docs, RESULT)
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.size(F.split("text", " "))), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_words))
    items = items.withColumn("block", F.pmod(F.xxhash64(F.coalesce("item", "text")), F.lit(blocks)))

    kept = [StructField(f.name, f.dataType) for f in base.schema]
    span = StructType.fromDDL("start int, stop int")
    carried = StructType([*kept, StructField("__v_text", StringType()), StructField("__v_spans", ArrayType(span)), StructField("__v_items", ArrayType(StringType()))])
    result = StructType(
        [
            *kept, StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("items", ArrayType(StringType())),
            StructField("contaminated", BooleanType()), StructField("spans", ArrayType(span)), StructField("clean_text", StringType()),
        ]
    )
    df = base.select(
        "*", F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__v_text"),
        F.array().cast(ArrayType(span)).alias("__v_spans"), F.array().cast("array<string>").alias("__v_items"),
    )
    merge = _merge(base.columns)
    for block in range(blocks):
        rows = [(r["item"], r["text"]) for r in items.where(F.col("block") == block).collect()]
        search = _search(Phrases(rows, window), carried.names)
        if block == blocks - 1:  # the last block and the result share a worker
            return df.mapInArrow(lambda batches: merge(search(batches)), result)
        df = df.mapInArrow(search, carried)


def op8_decontamination(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    return decontaminate(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )

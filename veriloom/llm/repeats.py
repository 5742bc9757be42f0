"""Removal of long repeated passages with longest-previous-factor arrays.

A byte is removed when some string of ``length`` bytes that covers it also
starts elsewhere, in the same text or another one. ``keep_first`` leaves the
earliest place (by id, then position) of every string.

1. Every window of ``length`` bytes picks its least ``GRAM``-byte substring by
   digest, leftmost on ties, as anchor. The choice depends on the window's bytes
   alone, so equal windows share an anchor. Neighbouring windows mostly share
   one too: about one row per 70 bytes leaves the scan.
2. Anchors that occur once cannot lie in a repeated window and are dropped by a
   count with partial sums. Where all windows of an anchor equal those of
   another place, the bytes are one digest and the whole run is decided by
   another count; whole copies end here.
3. For the rest, at the ends of matches, one run per distinct content goes to
   its anchor's partition. There a suffix array over the runs is built by prefix
   doubling, cut at ``length``; in suffix order, the nearest smaller positions
   before and after give the longest previous factor of every start.
4. An anchor with more than ``HOT`` distinct runs would fill one task. Its
   windows are counted instead, in pieces: a piece whose common bytes are unique
   holds no repeat, the windows of the others are counted with partial sums.

Every way is exact up to 64-bit digests (128 in step 2). Texts are shuffled
once, by id and text digest; the removed spans meet them in the same partitions.

Null and empty texts, and texts shorter than ``length``, lose nothing. Repeated
rows are copies of each other. Rows that share an id keep apart by a 64-bit
digest of their texts, and are ordered by it; a null id is an id of its own. An
empty table gives an empty result. Columns named like a result are replaced. Cuts are byte positions, so
``kept`` is bytes: a cut may fall inside a character.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from ..session import through_table
from .columns import without
from .shingling import buffers, chunks, mix, prefix_sums, ranges, rolling, slices

LENGTH = 200
GRAM = 64
HOT = 4096
PIECE = 16
#: Bytes of runs in one suffix array; a task builds one after the other.
BLOCK = 1_000_000
NO_ID = -(2**63)
RESULT = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
_U = np.uint64


# ---------------------------------------------------------------- anchors


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    span, least = 1, values
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def pack(at: np.ndarray, before: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Anchor position, windows before it and number of windows less one in one long."""
    return (at << 32) | (before << 24) | ((count - 1) << 16)


def unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window start, last window start) inside the text."""
    at, before, count = packed >> 32, (packed >> 24) & 255, ((packed >> 16) & 255) + 1
    return at, at - before, at - before + count - 1


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(text, gram digest, run digest, packed place) of every run of windows with one anchor."""
    n = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none
    sums = prefix_sums(data)
    grams = rolling(sums, gram)
    keys = grams & _U(0xFFFFFFFF00000000)
    keys |= np.arange(len(grams), dtype=_U)
    least = sliding_least(keys, length - gram + 1)
    anchor = (least & _U(0xFFFFFFFF)).astype(np.int64)
    change = np.ones(n + 1, bool)
    np.not_equal(anchor[1:], anchor[:-1], out=change[1:n])
    # Windows that would leave their text end a run and belong to none.
    outside = np.zeros(n + 1, np.int32)
    np.add.at(outside, np.minimum(np.maximum(offsets[1:] - length + 1, offsets[:-1]), n), 1)
    np.add.at(outside, np.minimum(offsets[1:], n), -1)
    whole = np.cumsum(outside[:n]) == 0
    change[offsets[(offsets > 0) & (offsets < n)]] = True
    change[1:n] |= whole[1:] != whole[:-1]
    first = np.flatnonzero(change[:n] & whole)
    if not len(first):
        return none, none, none, none
    last = np.flatnonzero(change[1:] & whole)
    a, t = anchor[first], np.searchsorted(offsets, first, side="right") - 1
    before = a - first
    run = mix(ranges(sums, first, last + length) + before.astype(_U) * _U(0x9E3779B97F4A7C15))
    return t, grams[a].view(np.int64), run.view(np.int64), pack(a - offsets[t], before, last - first + 1)


def _anchor_pass(length: int, gram: int):
    def run(batches):
        for batch in batches:
            ids, tags = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for row, data, offsets in chunks(batch.column(2)):
                t, k, u, packed = anchors_of(data, offsets, length, gram)
                if len(t):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k), pa.array(u), pa.array(ids[row + t]), pa.array(tags[row + t]), pa.array(packed)],
                        ["k", "u", "id", "tag", "place"],
                    )

    return run


# ---------------------------------------------------------------- runs and pieces


def _cut_pass(length: int, gram: int, piece: int):
    """Bytes of the open runs, and pieces of window digests of the hot ones; the last inputs are text, id, tag and spots."""

    def run(batches):
        seen: set[tuple[int, int]] = set()  # equal rows have equal runs: one of them is cut; emptied when full, which costs time only
        for batch in slices(batches):
            data, offsets = buffers(batch.column(batch.num_columns - 4))
            ids, tags = (batch.column(batch.num_columns - i).to_numpy(zero_copy_only=False) for i in (3, 2))
            spots = batch.column(batch.num_columns - 1)
            out = {c: [] for c in ("kind", "key", "id", "tag", "start", "open", "data", "windows")}
            size = 0
            for row in range(len(batch)):
                own = (int(ids[row]), int(tags[row]))
                if own in seen:
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                seen.add(own)
                text = data[offsets[row] : offsets[row + 1]]
                raw, sums = text.tobytes(), None
                for spot in spots[row].as_py():
                    at, first, last = (int(x) for x in unpack(np.int64(spot["place"])))
                    if not spot["hot"]:
                        found = [(0, spot["k"], first, raw[first : last + length], None)]
                    else:
                        if sums is None:
                            sums = prefix_sums(text)
                        found = []
                        for q in range((at - last) // piece, (at - first) // piece + 1):
                            low, high = max(first, at - q * piece - piece + 1), min(last, at - q * piece)
                            common = ranges(sums, np.array([at - q * piece]), np.array([at - q * piece - piece + 1 + length]))
                            key = mix(common + _U(q) * _U(0xD6E8FEB86659FD93)).view(np.int64)[0]
                            s = np.arange(low, high + 1)
                            found.append((1, int(key), low, None, ranges(sums, s, s + length).view(np.int64).tolist()))
                    for kind, key, start, piece_data, windows in found:
                        for c, v in zip(out, (kind, key, *own, start, spot["open"], piece_data, windows)):
                            out[c].append(v)
                        size += len(piece_data or b"") + 8 * len(windows or ())
                if size > 4_000_000:
                    yield _cut_batch(out)
                    out, size = {c: [] for c in out}, 0
            if out["key"]:
                yield _cut_batch(out)

    return run


CUT = "kind int, key long, id long, tag long, start int, open boolean, data binary, windows array<long>"
_CUT_TYPES = {
    "kind": pa.int32(), "key": pa.int64(), "id": pa.int64(), "tag": pa.int64(), "start": pa.int32(), "open": pa.bool_(),
    "data": pa.binary(), "windows": pa.list_(pa.int64()),
}


def _cut_batch(out: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in _CUT_TYPES.items()], list(_CUT_TYPES))


# ---------------------------------------------------------------- suffix array


def ranked(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of ``keys``, equal for equal keys."""
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    step = np.zeros(len(keys), np.int64)
    step[1:] = sorted_[1:] != sorted_[:-1]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(step)
    return out


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of ``data[i:i + length]`` among all starts, by prefix doubling; ``data`` ends in ``length`` zeros."""
    n = len(data) - length
    word = np.zeros(len(data) - 7, _U)
    for b in range(8):
        word = (word << _U(8)) | data[b : len(data) - 7 + b].astype(_U)
    have, rank = 8, ranked(word)
    while have * 2 <= length:
        rank = ranked((rank[:-have].astype(_U) << _U(32)) | rank[have:].astype(_U))
        have *= 2
    if have < length:
        shift = length - have
        rank = ranked((rank[: len(rank) - shift].astype(_U) << _U(32)) | rank[shift:].astype(_U))
    return rank[:n]


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value before each place, or -1, by jumping along known answers."""
    at = np.arange(len(values)) - 1
    todo = np.flatnonzero((at >= 0) & (values[np.maximum(at, 0)] > values))
    while len(todo):
        at[todo] = at[at[todo]]
        todo = todo[(at[todo] >= 0) & (values[np.maximum(at[todo], 0)] > values[todo])]
    return at


def previous_factors(rank: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every start: whether its string occurs at an earlier start, and whether it occurs elsewhere at all.

    In suffix order the nearest smaller positions before and after a suffix are
    the ends of its longest previous factor; with ranks cut at the length, that
    factor is long enough when one of them has the same rank.
    """
    order = np.lexsort((starts, rank[starts]))
    position, r = starts[order], rank[starts][order]
    before = nearest_smaller(position)
    after = len(position) - 1 - nearest_smaller(position[::-1])[::-1]
    same = lambda j: (j >= 0) & (j < len(r)) & (r[np.clip(j, 0, len(r) - 1)] == r)
    earlier = same(before) | same(after)
    twin = np.zeros(len(r), bool)
    equal = r[1:] == r[:-1]
    twin[1:] |= equal
    twin[:-1] |= equal
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return earlier[back], twin[back]


def _factors(rows: list[tuple[int, int, int, bool, bytes]], length: int, keep_first: bool):
    """Removed spans (id, tag, start, stop) of runs (id, tag, start, open, bytes)."""
    # Equal rows of several tasks bring the same run; it is one place.
    rows = sorted(set(rows), key=lambda x: (x[0], x[1], x[2]))
    sizes = np.array([len(x[4]) for x in rows])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(x[4] for x in rows) + bytes(length), np.uint8)
    row = np.repeat(np.arange(len(rows)), sizes)
    place = np.arange(len(row))
    starts = place[place + length <= ends[row]]
    # Windows whose digest is alone need no place in the suffix array.
    digest = ranges(prefix_sums(data), starts, starts + length)
    order = np.argsort(digest, kind="stable")
    equal = digest[order][1:] == digest[order][:-1]
    shared = np.zeros(len(starts), bool)
    shared[order[1:][equal]] = True
    shared[order[:-1][equal]] = True
    starts = starts[shared]
    if not len(starts):
        return []
    # Only the bytes that these windows cover are ranked.
    cover = np.zeros(len(data) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + length, -1)
    used = np.cumsum(cover[:-1]) > 0
    moved = np.cumsum(used) - 1
    rank = suffix_ranks(np.concatenate([data[used], np.zeros(length, np.uint8)]), length)
    earlier, twin = previous_factors(rank, moved[starts])
    open_ = np.array([x[3] for x in rows])[row[starts]]
    gone = starts[(earlier if keep_first else twin) & open_]
    if not len(gone):
        return []
    split = np.flatnonzero((np.diff(gone) != 1) | (np.diff(row[gone]) != 0)) + 1
    begin, stop = gone[np.r_[0, split]], gone[np.r_[split - 1, len(gone) - 1]] + length
    base = np.array([x[2] for x in rows]) - (ends - sizes)
    r = row[begin]
    return [(rows[i][0], rows[i][1], int(b + base[i]), int(e + base[i])) for i, b, e in zip(r, begin, stop)]


def _factor_pass(length: int, keep_first: bool):
    def run(batches):
        def out(rows):
            found = _factors(rows, length, keep_first)
            cols = list(zip(*found)) if found else [[], [], [], []]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["id", "tag", "start", "stop"]
            )

        rows, size, last = [], 0, None
        for batch in batches:  # sorted by key: a block ends where the key changes
            keys = batch.column(0).to_numpy()
            cols = [batch.column(i).to_pylist() for i in range(1, 6)]
            for key, *row in zip(keys, *cols):
                if size > BLOCK and key != last:
                    yield out(rows)
                    rows, size = [], 0
                rows.append(tuple(row))
                size += len(row[4])
                last = key
        if rows:
            yield out(rows)

    return run


# ---------------------------------------------------------------- result


def _keep_pass(names: list[str]):
    """Append n_bytes, n_removed, n_spans, kept_sha256 and kept; the last two inputs are text and spans."""

    def run(batches):
        for batch in slices(batches):
            data, offsets = buffers(batch.column(batch.num_columns - 2))
            spans = batch.column(batch.num_columns - 1)
            out = [[], [], [], [], []]
            for row in range(len(batch)):
                text = data[offsets[row] : offsets[row + 1]]
                found = spans[row].as_py() or []
                keep, n, runs = text, 0, 0
                if found:
                    edge = np.zeros(len(text) + 1, np.int64)
                    for s in found:
                        edge[s["start"]] += 1
                        edge[s["stop"]] -= 1
                    gone = np.cumsum(edge[:-1]) > 0
                    n, runs = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                    keep = text[~gone]
                raw = keep.tobytes()
                for c, v in zip(out, (len(text), n, runs, hashlib.sha256(raw).hexdigest(), raw)):
                    c.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], *[pa.array(c, t) for c, t in zip(out, types)]], [*names, *RESULT]
            )

    return run


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, keep_first: bool = False, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with ``n_bytes, n_removed, n_spans, kept_sha256, kept`` appended."""
    if not 8 <= gram <= length - PIECE or length - gram >= 255:
        raise ValueError("gram must leave between PIECE and 254 windows to an anchor")
    base = without(docs, RESULT)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    id_, tag = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.xxhash64(text.cast("binary"))
    texts = base.select(id_.alias("id"), tag.alias("tag"), text.alias("text"))
    anchors = texts.mapInArrow(_anchor_pass(length, gram), "k long, u long, id long, tag long, place long")
    often = anchors.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k")
    places = through_table(anchors.join(often, "k"), "places")
    runs = through_table(
        places.groupBy("k", "u").agg(F.count("*").alias("c"), F.min(F.struct("id", "tag", "place")).alias("first")), "runs"
    )
    kinds = runs.groupBy("k").agg(F.count("*").alias("m"), F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("alone")).where("m > 1")
    if not keep_first:
        kinds = kinds.where("alone > 0")

    # Runs that occur as a whole elsewhere.
    same = runs.where("c > 1").select("k", "u", "first")
    whole = places.join(same, ["k", "u"])
    if keep_first:
        whole = whole.where(F.struct("id", "tag", "place") != F.col("first"))
    before, count = F.shiftright("place", 24).bitwiseAND(255), F.shiftright("place", 16).bitwiseAND(255)
    start = F.shiftright("place", 32) - before
    decided = whole.select(
        "id", "tag", start.cast("int").alias("start"), (start + count + length).cast("int").alias("stop")
    )

    # One run of every content whose anchor has others.
    open_ = F.lit(True) if keep_first else F.col("c") == 1
    spots = (
        runs.join(kinds, "k")
        .select(F.col("first.id").alias("__v_id"), F.col("first.tag").alias("__v_tag"), F.struct("k", F.col("first.place").alias("place"), open_.alias("open"), (F.col("m") > hot).alias("hot")).alias("spot"))
        .groupBy("__v_id", "__v_tag")
        .agg(F.collect_list("spot").alias("spots"))
    )
    # Both joins take the same columns from the documents, so that Spark shuffles the texts once.
    keyed = base.withColumn("__v_id", id_).withColumn("__v_tag", tag)
    own = [F.col(f"`{c}`") for c in base.columns]
    cut = (
        keyed.join(spots, ["__v_id", "__v_tag"])
        .select(*own, F.col(text_col).cast("string").alias("__v_text"), "__v_id", "__v_tag", "spots")
        .mapInArrow(_cut_pass(length, gram, PIECE), CUT)
    )
    local = (
        cut.where("kind = 0").select("key", "id", "tag", "start", "open", "data").repartition("key").sortWithinPartitions("key")
        .mapInArrow(_factor_pass(length, keep_first), "id long, tag long, start int, stop int")
    )

    # Windows of hot anchors, counted.
    pieces = cut.where("kind = 1").select("key", "id", "tag", "start", "open", "windows")
    live = pieces.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    windows = pieces.join(live, "key").select("key", "id", "tag", "start", "open", F.posexplode("windows").alias("i", "w"))
    windows = windows.withColumn("start", F.col("start") + F.col("i")).drop("i")
    twice = windows.groupBy("key", "w").agg(F.count("*").alias("c"), F.min(F.struct("id", "tag", "start")).alias("first")).where("c > 1")
    hits = windows.join(twice.drop("c"), ["key", "w"]).where("open")
    if keep_first:
        hits = hits.where(F.struct("id", "tag", "start") != F.col("first"))
    counted = hits.select("id", "tag", "start", (F.col("start") + length).alias("stop"))

    # Equal rows bring equal spans, which count once.
    found = decided.unionByName(local).unionByName(counted)
    spans = found.groupBy(F.col("id").alias("__v_id"), F.col("tag").alias("__v_tag")).agg(F.collect_set(F.struct("start", "stop")).alias("__v_spans"))
    kinds_ = [StructField(f.name, f.dataType) for f in base.schema]
    result = [StructField(c, LongType()) for c in RESULT[:3]] + [StructField("kept_sha256", StringType()), StructField("kept", BinaryType())]
    joined = (
        keyed.join(spans, ["__v_id", "__v_tag"], "left")
        .select(*own, F.col(text_col).cast("string").alias("__v_text"), "__v_spans")
    )
    return joined.mapInArrow(_keep_pass(base.columns), StructType([*kinds_, *result]))


def op3_repeats(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", *RESULT[:4])

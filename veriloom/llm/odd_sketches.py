"""Near copies by banded MinHash samples, screened by odd sketches and confirmed on whole sets.

Documents link when the Jaccard similarity of their sets of two-word shingles
is at least ``THRESHOLD`` percent.

1. One pass digests every text: its set, ``BANDS`` times ``ROWS`` MinHash
   samples, one digest per band of samples, and the odd sketch. The odd sketch
   is a bitmap in which every sample flips one bit, so a bit holds the parity
   of the samples that fall on it. Texts with one set are one class from here
   on, told apart by 128 bits.
2. Classes that share a band are candidates. A pair at the threshold shares
   none of them with probability (1 - 0.8^5)^52, about one in 10^9.
3. Equal samples cancel in the XOR of two sketches; its population count
   estimates how many samples differ. A pair goes only if its count lies beyond
   ``most_odd``, more than six standard deviations above what the threshold gives.
4. What is left is confirmed on whole sets, read again for these classes only.

Groups of thousands never meet pair by pair. First each class is compared with
one other, of the best connected members of its bands the one it shares most
bands with; the links are merged to components. Then classes of one band that
are still apart meet: in short bands by a join, in long bands once under their
best connected member, in blocks of a bounded size. A task compares the
sketches of two blocks and counts what the remaining pairs share on whole sets,
so only links leave it. The list of block pairs is dealt out by block, not by
group.

Null and empty texts, and texts without words, have no shingles and no links; a
text of one word is one shingle. Whole texts are read, however long. Repeated
rows are one class. Rows that share an id are one node, so what they link to is
one component. A row without an id takes the component of its class, or none;
it links nothing, and is kept if no row with an id has its set. Extra columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import through_table
from .graph import components
from .shingling import mix, sets

SIZE = 2
THRESHOLD = 80
BANDS, ROWS = 52, 5
BITS = 1024
#: Bands with more classes than this are compared in blocks of about ``BLOCK`` classes.
LONG_BAND = 16
BLOCK = 512
#: Shingles whose membership is multiplied at once.
WIDE = 4096
#: Parts into which rows that meet one family's number of blocks are spread.
SPREAD = 32
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(11))
_FACTORS = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | _U(1)
_SALTS = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)
_PLACES = _rng.integers(1, 2**63, (2, 1 << 10), dtype=np.uint64) | _U(1)


def most_odd(threshold: int = THRESHOLD, samples: int = BANDS * ROWS, bits: int = BITS, deviations: float = 6.5) -> int:
    """Largest XOR count that a pair at the threshold may show.

    The differing samples are binomial; each flips two bits of the XOR. The
    count of odd bits after m flips has mean bits (1 - (1 - 2/bits)^m) / 2 and a
    variance below that mean.
    """
    apart = 1 - threshold / 100
    differ = min(samples, samples * apart + deviations * sqrt(samples * apart * (1 - apart)))
    mean = bits * (1 - (1 - 2 / bits) ** (2 * differ)) / 2
    return ceil(mean + deviations * sqrt(mean))


def similarity(odd: int, samples: int = BANDS * ROWS, bits: int = BITS) -> float:
    """The estimate that an XOR count stands for."""
    return 1 + bits / (4 * samples) * np.log(max(1 - 2 * odd / bits, 1e-9))


def samples_of(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash samples, one row each; set i is ``flat[first[i]:first[i + 1]]`` and not empty."""
    out = np.empty((len(_FACTORS), len(first) - 1), np.uint64)
    room = np.empty_like(flat)
    for k, (factor, salt) in enumerate(zip(_FACTORS, _SALTS)):
        np.multiply(flat, factor, out=room)
        np.bitwise_xor(room, salt, out=room)
        np.minimum.reduceat(room, first[:-1], out=out[k])
    return out


def bands_of(samples: np.ndarray) -> np.ndarray:
    """One digest per band, a row per set."""
    weights = _PLACES[0, : len(samples)].reshape(BANDS, ROWS, 1)
    summed = (mix(samples).reshape(BANDS, ROWS, -1) * weights).sum(1)
    return mix(summed + np.arange(BANDS, dtype=_U)[:, None]).T.view(np.int64)


def sketches_of(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps as rows of ``BITS / 64`` longs."""
    place = (mix(samples * _PLACES[1, : len(samples), None]) & _U(BITS - 1)).astype(np.int64)
    n = samples.shape[1]
    counts = np.bincount((place + np.arange(n) * BITS).ravel(), minlength=n * BITS).reshape(n, BITS)
    return np.packbits((counts & 1).astype(np.uint8), axis=1, bitorder="little").view(np.int64)


def identity(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit digests of a sorted set."""
    place = np.arange(1, len(s) + 1, dtype=_U)
    one = mix(s ^ (place * _U(0x9E3779B97F4A7C15))).sum()
    two = mix(s + place * _U(0xC2B2AE3D27D4EB4F)).sum() + _U(len(s))
    return tuple(mix(np.array([one, two], _U)).view(np.int64).tolist())


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


DIGEST = "id long, h long, n long, k1 long, k2 long, bands array<long>, sketch array<long>"
#: Sets digested together.
TOGETHER = 64


def _digest(batches):
    """Digests of all texts; those without shingles have neither bands nor a sketch."""
    for batch in batches:
        held = []
        for row, s in sets(batch.column(2), SIZE):
            held.append((row, s))
            if len(held) == TOGETHER:
                yield from _digested(batch, held)
                held = []
        yield from _digested(batch, held)


def _digested(batch, held):
    for some in (True, False):
        part = [(row, s) for row, s in held if (len(s) > 0) == some]
        if not part:
            continue
        at = pa.array([row for row, _ in part])
        n = np.array([len(s) for _, s in part])
        keys = np.array([identity(s) for _, s in part], np.int64)
        if some:
            samples = samples_of(np.concatenate([s for _, s in part]), np.cumsum([0, *n]))
            bands, sketches = _lists(bands_of(samples)), _lists(sketches_of(samples))
        else:
            bands = sketches = pa.nulls(len(part), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), pa.array(n), pa.array(keys[:, 0]), pa.array(keys[:, 1]), bands, sketches],
            ["id", "h", "n", "k1", "k2", "bands", "sketch"],
        )


def _possible(n: Column, m: Column, threshold: int) -> Column:
    """Sizes so different that even a subset would stay below the threshold are out."""
    return 100 * F.least(n, m) >= threshold * F.greatest(n, m)


def _screened(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose sizes and sketches allow the threshold."""
    left = classes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("x"))
    right = classes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("y"))
    odd = F.aggregate(F.zip_with("x", "y", lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda s, c: s + c)
    return pairs.join(left, "a").join(right, "b").where(_possible(F.col("na"), F.col("nb"), threshold) & (odd <= most_odd(threshold))).select("a", "b").distinct()


def _wanted_sets(batches):
    """(node, shingles) of the texts whose set is the wanted one."""
    for batch in batches:
        nodes, first, second = (batch.column(k).to_pylist() for k in (1, 2, 3))
        rows = [(nodes[row], s.view(np.int64)) for row, s in sets(batch.column(0), SIZE) if identity(s) == (first[row], second[row])]
        flat = np.concatenate([s for _, s in rows]) if rows else np.zeros(0, np.int64)
        offsets = pa.array(np.cumsum([0, *[len(s) for _, s in rows]]), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in rows], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["node", "shingles"]
        )


def _sets_of(nodes: DataFrame, texts: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """(node, shingles) of some classes; only their texts are read again."""
    wanted = classes.join(nodes, "node", "left_semi").select(F.col("node").alias("id"), "h", "node", "k1", "k2")
    found = texts.join(wanted, ["id", "h"]).select("text", "node", "k1", "k2").mapInArrow(_wanted_sets, "node long, shingles array<long>")
    return through_table(found.distinct(), name)


def _confirmed(pairs: DataFrame, texts: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose whole sets reach the threshold."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    held = _sets_of(nodes, texts, classes, "sets")
    left = held.select(F.col("node").alias("a"), F.col("shingles").alias("s"))
    right = held.select(F.col("node").alias("b"), F.col("shingles").alias("t"))
    both = F.size(F.array_intersect("s", "t"))
    union = F.size("s") + F.size("t") - both
    return through_table(pairs.join(left, "a").join(right, "b").where(100 * both >= threshold * union).select("a", "b").distinct(), "links")


class _Block:
    """Classes of one block as arrays."""

    def __init__(self, held: pa.StructArray) -> None:
        self.node, self.n, self.root = (held.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("node", "n", "root"))
        sketch, sets_ = held.field("sketch"), held.field("shingles")
        self.sketch = sketch.flatten().to_numpy(zero_copy_only=False).reshape(len(self.n), -1).view(_U)  # numpy counts the bits of absolute values
        self.flat = sets_.flatten().to_numpy(zero_copy_only=False)
        self.owner = np.repeat(np.arange(len(self.n)), self.n)


def shared_sizes(one: _Block, two: _Block, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Sizes of all intersections between chosen sets, exactly: products of membership matrices, a few shingles at a time."""
    place, other = np.full(len(one.n), -1), np.full(len(two.n), -1)
    place[rows], other[columns] = np.arange(len(rows)), np.arange(len(columns))
    mine, yours = place[one.owner] >= 0, other[two.owner] >= 0
    a, b = one.flat[mine], two.flat[yours]
    common = np.intersect1d(a, b)
    out = np.zeros((len(rows), len(columns)), np.float32)
    for first in range(0, len(common), WIDE):
        some = common[first : first + WIDE]
        sides = []
        for values, owner, size in ((a, place[one.owner[mine]], len(rows)), (b, other[two.owner[yours]], len(columns))):
            at = np.minimum(np.searchsorted(some, values), len(some) - 1)
            here = some[at] == values
            member = np.zeros((size, len(some)), np.float32)
            member[owner[here], at[here]] = 1
            sides.append(member)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _face(threshold: int):
    """Links between two blocks of classes; of those from a class to one component, the first.

    Only pairs in different components whose sizes and sketches allow the
    threshold are counted on whole sets, inside the task.
    """
    most = most_odd(threshold)

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                one, two = _Block(batch.column(0)[k].values), _Block(batch.column(1)[k].values)
                possible = np.zeros((len(one.n), len(two.n)), bool)
                for i in range(len(one.n)):
                    at = np.flatnonzero((two.root != one.root[i]) & (100 * np.minimum(two.n, one.n[i]) >= threshold * np.maximum(two.n, one.n[i])))
                    possible[i, at[np.bitwise_count(two.sketch[at] ^ one.sketch[i]).sum(1) <= most]] = True
                rows, columns = np.flatnonzero(possible.any(1)), np.flatnonzero(possible.any(0))
                if not len(rows):
                    continue
                both = shared_sizes(one, two, rows, columns)
                union = one.n[rows][:, None] + two.n[columns][None, :] - both
                linked = possible[np.ix_(rows, columns)] & (100 * both >= threshold * union)
                i, j = np.nonzero(linked)
                if len(i):
                    _, first = np.unique(np.stack([i, two.root[columns[j]]]), axis=1, return_index=True)
                    a, b = one.node[rows[i[first]]], two.node[columns[j[first]]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _families(apart: DataFrame, texts: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Links in long bands: families under one hub, in blocks that face each other."""
    members = apart.groupBy("hub", "node").agg(F.first("root").alias("root"))
    held = _sets_of(members.select("node").distinct(), texts, classes, "family-sets")
    family = members.join(classes.select("node", "n", "sketch"), "node").join(held, "node")
    # Blocks hold members of the family's largest component or others, so blocks of one component never meet.
    sizes = members.groupBy("hub", "root").agg(F.count("*").alias("c"))
    dealt = sizes.groupBy("hub").agg(F.ceil(F.sum("c") / BLOCK).cast("int").alias("blocks"), F.max(F.struct("c", "root")).alias("top"))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    blocks = through_table(
        family.withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(SPREAD)).cast("int"))
        .join(dealt, ["hub", "part"])
        .withColumn("block", 2 * F.pmod(F.xxhash64("node"), "blocks").cast("int") + (F.col("root") == F.col("top.root")).cast("int"))
        .groupBy("hub", "block")
        .agg(F.collect_list(F.struct("node", "n", "root", "sketch", "shingles")).alias("held"), F.min("root").alias("low"), F.max("root").alias("high")),
        "blocks",
    )
    listed = blocks.select("hub", "block", "low", "high")
    other = listed.select("hub", F.col("block").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    facing = listed.join(other, "hub").where("block <= other and not (low = high and low2 = high2 and low = low2)").select("hub", "block", "other")
    pairs = facing.join(blocks.select("hub", "block", "held"), ["hub", "block"])
    pairs = pairs.join(blocks.select("hub", F.col("block").alias("other"), F.col("held").alias("faced")), ["hub", "other"])
    return through_table(pairs.select("held", "faced").mapInArrow(_face(threshold), "a long, b long").distinct(), "links")


def near_copies(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per row of ``docs``."""
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    digests = through_table(texts.mapInArrow(_digest, DIGEST), "digests")
    classes = through_table(
        digests.where("n > 0 and id is not null").groupBy("k1", "k2")
        .agg(F.min(F.struct("id", "h")).alias("least"), F.max("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
        .select("k1", "k2", F.col("least.id").alias("node"), F.col("least.h").alias("h"), "n", "bands", "sketch"),
        "classes",
    )

    postings = classes.select(F.explode("bands").alias("band"), "node")
    shared = postings.groupBy("band").agg(F.count("*").alias("size"), F.min("node").alias("low"), F.max("node").alias("high"))
    lists = through_table(postings.join(shared.where("low <> high").select("band", "size"), "band"), "bands")
    # The best connected member of each band, and for every class the one of these with which it shares most bands.
    reach = lists.groupBy("node").agg(F.sum("size").alias("r"))
    hubs = lists.join(reach, "node").groupBy("band").agg(F.max(F.struct("r", "node"))["node"].alias("hub"))
    rows = through_table(lists.join(hubs, "band"), "members")
    stars = through_table(
        rows.where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("c"))
        .groupBy("node").agg(F.max(F.struct("c", "hub"))["hub"].alias("hub"))
        .select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(),
        "stars",
    )
    first = _confirmed(through_table(_screened(stars, classes, threshold), "pairs"), texts, classes, threshold)

    roots = components(first).select("node", "root")
    placed = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band")
    apart = through_table(placed.join(mixed, "band"), "apart")
    short = apart.where(F.col("size") <= LONG_BAND)
    side = lambda name: short.select("band", F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    met = side("a").join(side("b"), "band").where("a < b and a_root <> b_root").select("a", "b").distinct()
    rest = _screened(met, classes, threshold).join(stars, ["a", "b"], "left_anti")
    second = _confirmed(through_table(rest, "pairs"), texts, classes, threshold)
    third = _families(apart.where(F.col("size") > LONG_BAND), texts, classes, threshold)

    # Rows of one id in several classes tie these together.
    own = digests.where("n > 0 and id is not null").select("id", "k1", "k2").distinct()
    several = own.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id")
    tied = own.join(several, "id").join(classes.select("k1", "k2", "node"), ["k1", "k2"]).select(F.col("id").alias("a"), F.col("node").alias("b"))
    merged = components(first.union(second).union(third).union(tied))
    named = classes.select("k1", "k2", "node").join(merged, "node", "left").select("k1", "k2", F.coalesce("root", "node").alias("component"))
    component = F.coalesce("component", "id")
    return digests.select("id", "n", "k1", "k2").join(named, ["k1", "k2"], "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.when(F.col("id").isNull(), F.col("component").isNull()).otherwise(F.col("id") == component).alias("kept"),
    )


def op11_odd_sketches(spark, folder: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))

"""Odd sketches, Orchard's search and sliced bitmasks."""

import hashlib
import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from veriloom.llm import clusters, odd_sketches, shingling, vector_codes


def families(seed):
    r, rows = random.Random(seed), []
    for g in range(12):
        base = [f"w{g}_{r.randrange(3000)}" for _ in range(r.choice([1, 2, 3, 6, 12, 40, 150, 400]))]
        for _ in range(r.choice([1, 2, 6, 14])):
            copy = list(base)
            for _ in range(r.randrange(0, max(1, len(base) // 14) + 1)):
                copy[r.randrange(len(copy))] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("long_band", [16, 2])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_copies_against_all_pairs(table, monkeypatch, seed, long_band):
    monkeypatch.setattr(odd_sketches, "LONG_BAND", long_band)
    monkeypatch.setattr(odd_sketches, "BLOCK", 4)
    rows = families(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in odd_sketches.near_copies(table(rows)).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute.jaccard(rows, 2).items()}


def test_near_copies_of_odd_rows(table, odd):
    rows = [(i, t, "x") for i, t in odd] + [(None, "one two", "x"), (9, "Shared words of one text", "x"), (9, "no id here at all", "x"), (8, "shared words of one TEXT", "x")]
    out = odd_sketches.near_copies(table(rows, "doc_id long, text string, COMPONENT_ID string")).collect()
    assert len(out) == len(rows)
    null = sorted((r["n_shingles"], str(r["component_id"]), r["kept"]) for r in out if r["doc_id"] is None)
    # Copies of classes that have an id; row 9 ties its two texts together.
    assert null == [(1, "4", False), (4, "8", False)]
    named = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in out if r["doc_id"] is not None}
    assert named[1, 0] == (1, True) and named[4, 1] == (4, True) and named[9, 4] == (8, False) and named[8, 4] == (8, True) and named[5, 1] == (5, True)
    assert odd_sketches.near_copies(table([])).count() == 0
    lonely = odd_sketches.near_copies(table([(None, "quite alone here")])).collect()
    assert [(r["component_id"], r["kept"]) for r in lonely] == [(None, True)]


def test_sketches_estimate_and_never_drop_links():
    r = np.random.default_rng(5)
    for share in (0.8, 0.85, 0.95):
        odds = []
        for _ in range(60):
            n = int(r.integers(30, 600))
            both = round(2 * n * share / (1 + share))
            x = r.integers(1, 2**63, 2 * n, dtype=np.uint64)
            a, b = np.sort(x[:n]), np.sort(np.concatenate([x[:both], x[n : 2 * n - both]]))
            samples = odd_sketches.samples_of(np.concatenate([a, b]), np.array([0, n, 2 * n]))
            one, two = odd_sketches.sketches_of(samples).view(np.uint64)
            odds.append(int(np.bitwise_count(one ^ two).sum()))
            bands = odd_sketches.bands_of(samples)
            assert (bands[0] == bands[1]).any()
        assert max(odds) <= odd_sketches.most_odd()
        assert abs(np.mean([odd_sketches.similarity(o) for o in odds]) - share) < 0.03


def test_faced_blocks_give_all_links(monkeypatch):
    monkeypatch.setattr(odd_sketches, "WIDE", 16)
    r = random.Random(9)
    texts = [f"t{k % 5} " + " ".join(f"w{k % 5}_{j}" if r.random() > 0.04 else f"x{r.randrange(10**6)}" for j in range(60)) for k in range(60)]
    sets = [s for _, s in shingling.sets(pa.array(texts), 2)]
    samples = odd_sketches.samples_of(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    sketches = odd_sketches.sketches_of(samples)
    block = [{"node": k, "n": len(s), "root": k % 7, "sketch": sketches[k].tolist(), "shingles": s.view(np.int64).tolist()} for k, s in enumerate(sets)]
    longs = pa.list_(pa.int64())
    kind = pa.list_(pa.struct([("node", pa.int64()), ("n", pa.int64()), ("root", pa.int64()), ("sketch", longs), ("shingles", longs)]))
    batch = pa.RecordBatch.from_arrays([pa.array([block], kind), pa.array([block], kind)], ["held", "faced"])
    got = {(a, b) for out in odd_sketches._face(80)([batch]) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())}
    link = lambda x, y: 100 * len(set(x.tolist()) & set(y.tolist())) >= 80 * len(set(x.tolist()) | set(y.tolist()))
    want = {(x, y) for x in range(60) for y in range(x + 1, 60) if x % 7 != y % 7 and link(sets[x], sets[y])}
    assert got <= want and want and len(got) < len(want)
    # Every class has a link to every component that it links to.
    assert {(x, y % 7) for a, b in got for x, y in ((a, b), (b, a))} == {(x, y % 7) for a, b in want for x, y in ((a, b), (b, a))}


def test_samples_follow_similarity():
    sets = dict(shingling.sets(pa.array(["a b c d e f", "a b c d e g", ""]), 2))
    assert len(sets[0]) == 5 and len(sets[2]) == 0
    samples = odd_sketches.samples_of(np.concatenate([sets[0], sets[1]]), np.array([0, 5, 10]))
    assert 0.5 < (samples[:, 0] == samples[:, 1]).mean() < 0.8  # four of six are shared


# ------------------------------------------------ vectors


def plain_nearest(vectors, centers):
    distance = ((vectors[:, None] - centers[None]) ** 2).sum(2)
    return distance.argmin(1), distance.min(1)


@pytest.mark.parametrize("seed", range(4))
def test_searches_are_exact_with_ties(seed):
    r = np.random.default_rng(seed)
    centers = r.integers(-3, 4, (40, 3))
    centers[20:25] = centers[:5]
    vectors = r.integers(-5, 6, (700, 3))
    want = plain_nearest(vectors, centers)
    for got in (clusters.Orchard(centers).nearest(vectors), clusters.Orchard(centers).nearest(vectors, want[0]), vector_codes.Sliced(centers).nearest(vectors)):
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    far = vectors * 100_000
    got = vector_codes.Sliced(centers).nearest(far)
    assert (got[0] == plain_nearest(far, centers)[0]).all()


def test_orchard_measures_few():
    r = np.random.default_rng(1)
    centers = r.integers(0, 100_000, (64, 2))
    search = clusters.Orchard(centers)
    measured = []
    real = search.centers

    class Counting(np.ndarray):
        def __getitem__(self, key):
            out = np.asarray(real)[key]
            measured.append(len(out) if out.ndim > 1 else 1)
            return out

    search.centers = real.view(Counting)
    vectors = r.integers(0, 100_000, (500, 2))
    got = search.nearest(vectors)
    assert (got[0] == plain_nearest(vectors, real)[0]).all() and sum(measured) < 500 * 64 / 2


def test_masks_are_the_cube():
    r = np.random.default_rng(2)
    entries, pieces = r.integers(-50, 50, (130, 4)), r.integers(-60, 60, (90, 4))
    mask = vector_codes.Sliced(entries).inside(pieces, np.full(90, 20))
    bits = np.unpackbits(mask.view(np.uint8), axis=1, bitorder="little")[:, :130].astype(bool)
    assert (bits == (np.abs(pieces[:, None] - entries[None]) <= 20).all(2)).all()


VECTORS = "vec_id long, embedding array<float>, label int, ERROR string"


def odd_vectors(width):
    r = random.Random(width)
    good = [(k, [r.gauss(0, 0.2) for _ in range(width)], k % 3 or None, "e") for k in range(30)]
    bad = [None, [], [0.1] * (width - 1), [float("nan")] + [0.0] * (width - 1), [float("-inf")] + [0.0] * (width - 1), [None] + [0.0] * (width - 1), [1e30] * width]
    return good, good + good[:5] + [(90 + k, v, 1, "e") for k, v in enumerate(bad)] + [(None, good[0][1], None, "e")]


def floored(v):
    return [int(np.floor(np.float64(np.float32(x)) * 1024)) for x in v]


def plain_clusters(rows, k, rounds):
    """rows: (id, whole vector)."""
    named = sorted({(hashlib.sha256(f"3:{i}".encode()).hexdigest(), tuple(v)) for i, v in rows if i is not None})
    by_hash = sorted([(hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None])
    assert named
    centers = [list(v) for _, v in by_hash[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centers))
    for _ in range(rounds):
        groups = {}
        for _, v in rows:
            groups.setdefault(near(v)[1], []).append(v)
        for n, g in groups.items():
            centers[n] = [sum(x) // len(g) for x in zip(*g)]
    return [(i, *near(v)[::-1]) for i, v in rows], centers


def test_clusters_of_odd_vectors(table):
    good, rows = odd_vectors(4)
    assigned, centers = clusters.cluster(table(rows, VECTORS), k=5, rounds=4, width=4)
    whole = [(i, floored(v)) for i, v, *_ in good + good[:5] + [rows[-1]]]
    want, last = plain_clusters(whole, 5, 4)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, assigned.collect()), key=key) == sorted(want, key=key) and centers.tolist() == last
    out = clusters.with_inertia(assigned, centers).collect()
    assert {r["inertia"] for r in out} == {sum(w[2] for w in want)}
    empty, none = clusters.cluster(table([], VECTORS))
    assert clusters.with_inertia(empty, none).count() == 0
    few, _ = clusters.cluster(table(rows[:3], VECTORS), k=8, rounds=2, width=4)
    assert {r["distance"] for r in few.collect()} == {0}


def test_codes_of_odd_vectors(table):
    good, rows = odd_vectors(8)
    coded, books = vector_codes.encode(table(rows, VECTORS), parts=4, entries=6, rounds=3)
    used = good + good[:5] + [rows[-1]]
    whole = np.array([floored(v) for _, v, *_ in used]).reshape(-1, 4, 2)
    seeds = sorted([(i, floored(v)) for i, v, *_ in good + good[:5]])[:6]
    plain = [np.array([v for _, v in seeds]).reshape(-1, 4, 2)[:, p] for p in range(4)]
    for _ in range(3):
        for p in range(4):
            near = plain_nearest(whole[:, p], plain[p])[0]
            for e in set(near.tolist()):
                plain[p][e] = [sum(x) // len(x) for x in whole[near == e, p].T.tolist()]
    assert [b.tolist() for b in books] == [b.tolist() for b in plain]
    found = [plain_nearest(whole[:, p], plain[p]) for p in range(4)]
    want = sorted((str(u[0]), str(u[2]), "".join(f"{found[p][0][k]:02x}" for p in range(4)), int(sum(found[p][1][k] for p in range(4)))) for k, u in enumerate(used))
    assert sorted((str(r["id"]), str(r["label"]), r["code"], r["error"]) for r in coded.collect()) == want
    errors = {}
    for _, label, _, error in want:
        errors[label] = errors.get(label, 0) + error
    out = vector_codes.with_label_errors(coded, books)
    assert all(errors[str(r["label"])] == r["label_error"] for r in out.collect()) and out.count() == len(want)
    assert vector_codes.with_label_errors(*vector_codes.encode(table([], VECTORS))).count() == 0
    assert vector_codes.encode(table([(1, [0.5] * 7, 1, "e")], VECTORS))[0].count() == 0

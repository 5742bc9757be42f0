"""Words and shingles of whole texts as 64-bit digests, vectorised over Arrow batches.

The digest of a word is a polynomial over its bytes, read off prefix sums of
the whole buffer; a shingle mixes the digests of its words in order. Nothing is
a Python object per word, and no more than ``CHUNK`` bytes (or one text) are
expanded at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 16
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_ORDER = _rng.integers(1, 2**63, 16, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes outside words: ASCII blanks only.
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bytes outside words: all of ASCII but digits and (lowered) letters.
NON_WORD = np.zeros(256, dtype=bool)
NON_WORD[:128] = True
NON_WORD[48:58] = NON_WORD[97:123] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, _U), np.ones(1, _U))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for n + 1 places."""
    global _powers
    if len(_powers[0]) < n + 1:
        size = max(n + 1, CHUNK + 1)
        made = []
        for b in (_BASE, _INVERSE):
            p = np.full(size, b, _U)
            p[0] = 1
            made.append(np.cumprod(p, dtype=_U))
        _powers = (made[0], made[1])
    return _powers


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Polynomial digests of all prefixes of ``data`` (uint8), one longer than it."""
    out = np.zeros(len(data) + 1, _U)
    terms = _BYTE[data]
    terms *= powers(len(data))[0][: len(data)]
    np.cumsum(terms, out=out[1:])
    return out


def ranges(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Digests of ``data[start:stop]``, equal for equal bytes anywhere."""
    return mix((sums[stop] - sums[start]) * powers(len(sums))[1][start] + (stop - start).astype(_U) * _U(_BASE))


def rolling(sums: np.ndarray, width: int) -> np.ndarray:
    """``ranges`` of all stretches of ``width`` bytes, from whole slices."""
    n = len(sums) - width
    x = sums[width:] - sums[:n]
    x *= powers(len(sums))[1][:n]
    x += _U((width * _BASE) % 2**64)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> _U(shift)
        x *= _U(factor)
    x ^= x >> _U(33)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    parts = column.buffers()
    offsets = np.frombuffer(parts[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(parts[2], np.uint8) if parts[2] is not None and parts[2].size else np.zeros(0, np.uint8)
    return data, offsets


def slices(batches, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, for passes that return texts."""
    for batch in batches:
        for row in range(0, len(batch), rows):
            yield batch.slice(row, rows)


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about ``CHUNK`` bytes."""
    data, offsets = buffers(column)
    n, row = len(offsets) - 1, 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
        last = min(last, n)
        cut = offsets[row : last + 1]
        yield row, data[cut[0] : cut[-1]], cut - cut[0]
        row = last


def word_spans(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of words in lowered ``data``, and the first word of each text."""
    inside = ~outside[data]
    before = np.zeros(len(data), bool)
    after = np.zeros(len(data), bool)
    if len(data):
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        before[edges] = False
        inner = offsets[1:-1]
        after[inner[inner > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    stop = np.flatnonzero(inside & ~after) + 1
    return start, stop, np.searchsorted(start, offsets)


def words(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the words of all texts in order, and each text's first word (one entry more than texts)."""
    lowered = LOWER[data]
    start, stop, first = word_spans(lowered, offsets, outside)
    return ranges(prefix_sums(lowered), start, stop), first


def shingles(digests: np.ndarray, size: int) -> np.ndarray:
    """Digest of every run of ``size`` words, by its first word."""
    n = len(digests) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    total = np.zeros(n, _U)
    for k in range(size):
        total += digests[k : k + n] * _ORDER[k]
    return mix(total)


def sets(column: pa.Array, size: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of every text; shorter texts are one shingle, texts without words none."""
    for row, data, offsets in chunks(column):
        w, first = words(data, offsets, BLANK)
        s = shingles(w, size)
        for i in range(len(offsets) - 1):
            a, b = first[i], first[i + 1]
            if b - a >= size:
                yield row + i, np.unique(s[a : b - size + 1])
            elif b > a:
                yield row + i, mix((w[a:b] * _ORDER[: b - a]).sum(keepdims=True) + _U(int(b - a)))
            else:
                yield row + i, np.zeros(0, _U)

"""A full-text index over integer sequences: suffix order, wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by prefix doubling; a shorter suffix precedes its extensions."""
    n = len(seq)
    if n <= 1:
        return np.arange(n)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64) + 1
    have = 1
    while True:
        second = np.zeros(n, np.int64)
        second[:-have or None] = rank[have:] if have < n else 0
        if have >= n:
            second[:] = 0
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        step = np.ones(n, np.int64)
        step[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        if rank[order[-1]] == n:
            return order
        have *= 2


class WaveletMatrix:
    """Rank of any symbol in a sequence, one bit plane per level."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        cur = seq
        for level in range(self.levels - 1, -1, -1):
            bit = (cur >> level) & 1
            count = np.zeros(len(cur) + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(cur) - int(count[-1]))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before ``place``, element by element."""
        low = np.zeros(len(place), np.int64)
        high = place.astype(np.int64)
        for depth, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (symbol >> (self.levels - 1 - depth)) & 1
            one_low, one_high = ones[low].astype(np.int64), ones[high].astype(np.int64)
            low = np.where(bit == 1, zeros + one_low, low - one_low)
            high = np.where(bit == 1, zeros + one_high, high - one_high)
        return high - low


class FMIndex:
    """Backward search and location over ``seq`` with symbols below ``symbols``; 0 never matches."""

    def __init__(self, seq: np.ndarray, symbols: int, sample: int = 16):
        # The end mark 0 is smaller than every symbol, so symbols move up by one.
        self.text = np.concatenate([seq.astype(np.int64) + 1, [0]])
        self.symbols = symbols + 1
        order = suffix_order(self.text)
        self.last = self.text[order - 1]
        self.before = np.zeros(self.symbols + 1, np.int64)
        np.cumsum(np.bincount(self.text, minlength=self.symbols), out=self.before[1:])
        self.ranks = WaveletMatrix(self.last, self.symbols)
        held = order % sample == 0
        self.held = held
        self.slot = np.cumsum(held) - 1
        self.sampled = order[held]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals [low, high) of the rows of ``phrases``, all of one length."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.text), np.int64)
        for column in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, column].astype(np.int64) + 1
            low = self.before[c] + self.ranks.rank(c, low)
            high = self.before[c] + self.ranks.rank(c, high)
            high = np.maximum(low, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-order rows: step back to the next sampled position."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        out = np.empty(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            here = at[todo]
            done = self.held[here]
            out[todo[done]] = self.sampled[self.slot[here[done]]] + steps[todo[done]]
            todo = todo[~done]
            here = at[todo]
            c = self.last[here]
            at[todo] = self.before[c] + self.ranks.rank(c, here)
            steps[todo] += 1
        return out

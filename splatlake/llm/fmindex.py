"""FM-index of one shard of word symbols: wavelet-matrix ranks, backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order, width = np.argsort(rank, kind="stable"), 1
    while n > 1:
        key = rank * (n + 1)
        key[:-width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        width *= 2
        if new[-1] == n - 1 or width >= n:
            break
    return order


class FMIndex:
    """Index over symbols >= 1; the text is closed by symbol 0 here."""

    def __init__(self, text: np.ndarray, symbols: int = 0, sample: int = SAMPLE):
        """symbols: a bound that the symbols of texts and phrases stay under, if not those of this text."""
        text = np.concatenate([text.astype(np.int64), [0]])
        order = suffix_array(text)
        bwt = text[order - 1]
        self.n, self.levels = len(text), max(1, max(int(text.max()), symbols).bit_length())
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << self.levels))])
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = bwt >> level & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(self.n - self.ones[-1][-1]))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        taken = order % sample == 0
        self.sampled = np.concatenate([[0], np.cumsum(taken, dtype=np.int32)])
        self.positions = order[taken]
        self.base = self._down(np.arange(1 << self.levels), np.zeros(1 << self.levels, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, ones in enumerate(self.ones):
            up = ones[at]
            at = np.where(symbols >> (self.levels - 1 - k) & 1, self.zeros[k] + up, at - up)
        return at

    def step(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """First row of suffixes that begin with each symbol, plus the symbol's rank before row ``at``."""
        return self.starts[symbols] + self._down(symbols, at) - self.base[symbols]

    def symbol(self, rows: np.ndarray) -> np.ndarray:
        """Last-column symbol of each row, read from the wavelet matrix."""
        out, at = np.zeros(len(rows), np.int64), rows
        for k, ones in enumerate(self.ones):
            up = ones[at]
            bit = ones[at + 1] - up
            out = out << 1 | bit
            at = np.where(bit, self.zeros[k] + up, at - up)
        return out

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [from, to) of the suffixes that begin with each phrase (rows of one length)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, k]
            low[alive], high[alive] = self.step(c, low[alive]), self.step(c, high[alive])
            alive = alive[low[alive] < high[alive]]
        found = np.zeros(len(phrases), bool)
        found[alive] = True
        return np.where(found, low, 0), np.where(found, high, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row, by stepping back to a sampled one."""
        out, rows, steps = np.zeros(len(rows), np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            at = rows[left]
            known = self.sampled[at + 1] > self.sampled[at]
            out[left[known]] = self.positions[self.sampled[at[known]]] + steps[left[known]]
            left = left[~known]
            rows[left] = self.step(self.symbol(rows[left]), rows[left])
            steps[left] += 1
        return out

"""Suffix automaton of many word sequences, with the number of places at which each of its strings ends."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np


class SuffixAutomaton:
    """Generalised suffix automaton; every sequence is added from the root with a weight (its number of copies)."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def __len__(self) -> int:
        return len(self.next)

    def _state(self, length: int, link: int, arcs: dict[int, int]) -> int:
        self.next.append(arcs)
        self.length.append(length)
        self.link.append(link)
        self.count.append(0)
        return len(self.next) - 1

    def _split(self, p: int, symbol: int, q: int) -> int:
        """The state of length[p] + 1 that p's arc must lead to: q itself, or a clone of it."""
        nxt, link, length = self.next, self.link, self.length
        if length[q] == length[p] + 1:
            return q
        clone = self._state(length[p] + 1, link[q], nxt[q].copy())
        link[q] = clone
        while p >= 0 and nxt[p].get(symbol) == q:
            nxt[p][symbol] = clone
            p = link[p]
        return clone

    def add(self, sequence: Iterable[int], weight: int = 1) -> None:
        nxt, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for symbol in sequence:
            q = nxt[last].get(symbol)
            if q is not None:
                last = self._split(last, symbol, q)
            else:
                state, p = self._state(length[last] + 1, 0, {}), last
                while p >= 0 and symbol not in nxt[p]:
                    nxt[p][symbol] = state
                    p = link[p]
                if p >= 0:
                    link[state] = self._split(p, symbol, nxt[p][symbol])
                last = state
            count[last] += weight

    def close(self) -> None:
        """Pass the counts on to suffixes: afterwards count[s] is how often the strings of s occur."""
        link, count = self.link, self.count
        for s in np.argsort(self.length, kind="stable")[:0:-1].tolist():
            count[link[s]] += count[s]

    def matching_statistics(self, sequence: Sequence[int], cap: int) -> tuple[list[int], list[int]]:
        """For each end the length of the longest suffix (of at most ``cap``) that is in the automaton, and how often it occurs there."""
        nxt, link, length, count = self.next, self.link, self.length, self.count
        state = size = 0
        sizes, counts = [], []
        for symbol in sequence:
            while state and symbol not in nxt[state]:
                state = link[state]
                size = length[state]
            to = nxt[state].get(symbol)
            if to is None:
                state = size = 0
            else:
                state, size = to, size + 1
                if size > cap:
                    size = cap
                while length[link[state]] >= size:
                    state = link[state]
            sizes.append(size)
            counts.append(count[state] if size else 0)
        return sizes, counts

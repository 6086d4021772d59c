"""Vectorised word scanning of Arrow text columns, shared by the operators on word sequences.

A text column is walked in slices of about ``CHUNK_BYTES``; in each slice the words of all
documents are found and hashed with numpy on the Arrow buffer itself, so no Python object is
made for a word. A word hash is a polynomial over the word's bytes modulo 2**64 with random
coefficients, finished with a bit mixer; equal words have equal hashes in every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5
_MASK = (1 << 64) - 1

SPACE = frozenset([0x20, *range(0x09, 0x0E)])
#: Bytes that separate words in `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, once A-Z are lower-cased.
NOT_ALNUM = frozenset(b for b in range(0x80) if not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A))


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base & _MASK, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            size = len(self.up)
            self.up = np.concatenate([self.up, self.up * _U(pow(self.base, size, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * _U(pow(self.inverse, size, 1 << 64))])
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS = _Powers(_BASE), _Powers(0xD6E8FEB86659FD93)
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.int64).astype(_U)


def ranges_of(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text each (one row at least)."""
    offsets = offsets_of(texts)
    row, rows = 0, len(texts)
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(rows, max(end, row + 1))
        yield row, end
        row = end


def offsets_of(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if len(texts) == 0:
        return np.zeros(1, np.int64)
    return np.frombuffer(texts.buffers()[1], kind, len(texts) + 1, texts.offset * kind().itemsize).astype(np.int64)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column without nulls (null: empty)."""
    array = batch.column(batch.schema.get_field_index(name))
    return array.fill_null("") if array.null_count else array


@dataclass
class Words:
    """Words of the documents of rows [row, row + n) of a batch."""

    row: int
    data: np.ndarray  # bytes of the slice
    doc_bytes: np.ndarray  # n + 1 offsets of documents in data
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    doc: np.ndarray  # n + 1 offsets of documents in words
    hash: np.ndarray | None

    @property
    def n(self) -> int:
        return len(self.doc) - 1

    def limit(self) -> np.ndarray:
        """For each word the word offset at which its document ends."""
        return np.repeat(self.doc[1:], np.diff(self.doc))

    def ngrams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; meaningless where the document ends before."""
        n = len(self.start)
        if n < k:
            return np.zeros(n, _U)
        up, down = _WORD_POWERS.get(n + 1)
        total = np.zeros(n + 1, _U)
        np.cumsum(self.hash * up[:n], out=total[1:])
        out = np.zeros(n, _U)
        out[: n - k + 1] = mix((total[k:] - total[:-k]) * down[: n - k + 1])
        return out


class Scanner:
    """Finds words: maximal runs of bytes outside ``separators``; ``lower`` folds A-Z first."""

    def __init__(self, separators: frozenset[int] = SPACE, lower: bool = False, hashed: bool = True):
        self.inside = np.ones(256, bool)
        self.inside[list(separators)] = False
        self.values = _BYTE_VALUES.copy()
        if lower:
            self.values[0x41:0x5B] = self.values[0x61:0x7B]
        self.hashed = hashed

    def __call__(self, texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Words]:
        offsets = offsets_of(texts)
        whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        for row, end in ranges_of(texts, limit):
            at = offsets[row : end + 1] - offsets[row]
            yield self.words(row, whole[offsets[row] : offsets[end]], at)

    def words(self, row: int, data: np.ndarray, at: np.ndarray) -> Words:
        n = len(data)
        inside = self.inside[data]
        first = at[:-1][at[:-1] < at[1:]]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[first] = inside[first]
        ends = inside.copy()
        if n:
            ends[:-1] &= ~inside[1:]
            ends[-1] = inside[-1]
        last = first[first > 0] - 1
        ends[last] = inside[last]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        doc = np.searchsorted(start, at)
        hashed = None
        if self.hashed:
            up, down = _BYTE_POWERS.get(n + 1)
            total = np.zeros(n + 1, _U)
            np.cumsum(self.values[data] * up[:n], out=total[1:])
            hashed = mix((total[end] - total[start]) * down[start])
        return Words(row, data, at, start, end, doc, hashed)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i : i + w] for each i; windows that run over the end keep what there is."""
    return _sliding(x, w, np.minimum)


def sliding_max_back(x: np.ndarray, w: int) -> np.ndarray:
    """Maximum of x[i - w + 1 : i + 1] for each i."""
    return _sliding(x[::-1], w, np.maximum)[::-1]


def _sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    out, width = x.copy(), 1
    while width < w:
        step = min(width, w - width)
        if step >= len(out):
            return out if len(out) <= 1 else _tail(x, f)
        out[:-step] = f(out[:-step], out[step:].copy())
        width += step
    return out


def _tail(x: np.ndarray, f) -> np.ndarray:
    return f.accumulate(x[::-1])[::-1]


def sub_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(s, s + n) over pairs (s, n)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return np.arange(total) + shift

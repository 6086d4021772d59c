"""Whitening of embeddings by the principal components of their covariance.

Each partition computes the count, mean and centred scatter of its vectors, batch by batch; two such moments
are merged by Chan's formula, in a tree of tasks (``treeReduce``). The driver has one d x d scatter and takes its
eigenvectors. A second pass computes the covariance of the whitened vectors in the same way and says how
far it is from the identity. Memory is d x d numbers in a task, whatever the rows.

An entry c becomes the whole number floor(scale * c) + shift; sums of these are kept exactly beside the means.

Defined results: a vector that is null, empty or has null or non-finite entries, or entries too large for a 63-bit whole number, takes no part; of vectors
of several lengths the most frequent one is taken (ties: the longest), and the others take no part; repeated rows count as
rows each; a component without variance (equal vectors, fewer rows than dimensions) has no whitened value (null) and
is left out of the identity's error, which is null if there is no other; without any vector there are no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splatlake.llm.tree import tree_reduced

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Share of the trace under which a component counts as one without variance.
NO_VARIANCE = 1e-12
#: Numbers that a task works on at once.
BLOCK = 1 << 20


@dataclass
class Moments:
    """Count, exact sums, mean and centred scatter of vectors."""

    n: int = 0
    sums: list[int] = field(default_factory=list)
    mean: np.ndarray | None = None
    scatter: np.ndarray | None = None

    @classmethod
    def of(cls, rows: np.ndarray) -> Moments:
        mean = rows.mean(0, dtype=np.float64)
        centred = rows - mean
        return cls(len(rows), exact_sums(rows) if rows.dtype == np.int64 else [], mean, centred.T @ centred)

    def __add__(self, other: Moments) -> Moments:
        """Chan's formula; neither side is changed."""
        if not self.n or not other.n:
            return self if self.n else other
        n, delta = self.n + other.n, other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(delta, delta) * (self.n * other.n / n)
        return Moments(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], self.mean + delta * (other.n / n), scatter)


def exact_sums(rows: np.ndarray) -> list[int]:
    """Sums of columns of 63-bit whole numbers as Python integers."""
    high, low = rows >> 32, rows & 0xFFFFFFFF
    return [(int(h) << 32) + int(v) for h, v in zip(high.sum(0), low.sum(0), strict=True)]


@dataclass(frozen=True)
class Whitening:
    """What a fit leaves: count, exact sums, eigenvalues (falling), their vectors (columns), trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    scale: int
    shift: int

    @property
    def usable(self) -> np.ndarray:
        return self.values > NO_VARIANCE * self.trace

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit integers where they can hold it, else Python's."""
        fits = (int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums))) < 1 << 62
        return self.n * (x if fits else x.astype(object)) - np.array(self.sums, np.int64 if fits else object)

    def __call__(self, d: np.ndarray) -> np.ndarray:
        """Whitened values of the usable components, from deviations."""
        return (d.astype(np.float64) / self.n) @ (self.vectors[:, self.usable] / np.sqrt(self.values[self.usable]))


def _vectors(batch: pa.RecordBatch, scale: int, shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, whole numbers) of vectors that take part, by length and in blocks."""
    column = batch.column(batch.num_columns - 1)
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for d in np.unique(lengths[lengths > 0]):
        every = np.flatnonzero(lengths == d)
        step = max(1, BLOCK // int(d))
        for k in range(0, len(every), step):
            at = every[k : k + step]
            x = np.floor(flat[starts[at][:, None] + np.arange(d)] * scale)
            good = (np.abs(x) < 2.0**62 - 2.0**40).all(1)  # not so for nan
            if good.any():
                yield at[good], x[good].astype(np.int64) + shift


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> Whitening | None:
    """Principal components of all vectors that take part; None if there are none."""

    def summary(batches: Iterator[pa.RecordBatch]) -> dict[int, Moments]:
        out: dict[int, Moments] = {}
        for batch in batches:
            for _, x in _vectors(batch, scale, shift):
                out[x.shape[1]] = out.get(x.shape[1], Moments()) + Moments.of(x)
        return out

    def merge(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
        return {d: a.get(d, Moments()) + b.get(d, Moments()) for d in a.keys() | b.keys()}

    found = tree_reduced(vectors.select(F.col(column)), summary, merge, {})
    if not found:
        return None
    d = max(found, key=lambda k: (found[k].n, k))
    m = found[d]
    covariance = m.scatter / m.n
    values, basis = np.linalg.eigh(covariance)
    k = min(components, d)
    return Whitening(m.n, tuple(m.sums), values[::-1][:k].copy(), basis[:, ::-1][:, :k].copy(), float(np.trace(covariance)), scale, shift)


def identity_error(vectors: DataFrame, model: Whitening, column: str = "embedding") -> float | None:
    """Largest absolute entry of the whitened vectors' covariance minus the identity: a pass over all vectors."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Moments:
        out = Moments()
        for batch in batches:
            for _, x in _vectors(batch, model.scale, model.shift):
                if x.shape[1] == len(model.sums):
                    out += Moments.of(model(model.deviations(x)))
        return out

    if not model.usable.any():
        return None
    m = tree_reduced(vectors.select(F.col(column)), summary, lambda a, b: a + b, Moments())
    return float(np.abs(m.scatter / m.n - np.eye(len(m.scatter))).max())


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """For each vector that takes part and component: key, component (from 1), n, deviation (exact), whitened, explained, identity_error.

    ``deviation``, the sum of (n * x - S)^2 over the dimensions, is a whole number of up to 38 digits (null beyond).
    """
    rows = vectors.select(F.col(key).cast("long"), F.col(column).cast("array<double>"))
    model = fit(rows, column, components, scale, shift)
    schema = f"`{key}` long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error, k = identity_error(rows, model, column), len(model.values)
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def squared(d: np.ndarray) -> pa.Array:
        if d.dtype != object and float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 2.0**62:
            return pa.array((d * d).sum(1)).cast(pa.decimal128(38, 0))
        exact = (d.astype(object) ** 2).sum(1)
        return pa.array([Decimal(int(v)) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _vectors(batch, scale, shift):
                if x.shape[1] != len(model.sums):
                    continue
                d = model.deviations(x)
                white = np.full((len(x), k), np.nan)
                white[:, model.usable] = model(d)
                part = np.full(k, np.nan) if not model.trace else model.values / model.trace
                every = np.repeat(np.arange(len(x)), k)
                size = len(every)
                columns = [batch.column(0).take(pa.array(at)).take(pa.array(every)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(size, model.n)), squared(d).take(pa.array(every))]
                columns += [pa.array(v, pa.float64(), from_pandas=True) for v in (white.ravel(), np.tile(part, len(x)))]
                columns.append(pa.array([error] * size, pa.float64()))
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(out, schema)

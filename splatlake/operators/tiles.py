"""Connected pieces inside spatial tiles, found by one task a tile; only what lies at the edges of tiles is joined.

A tile holds a bounded part of space, so its rows fit a task whatever the scene; a task takes several tiles at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows that a kernel is given at once, at least (and whole tiles).
ROWS = 1 << 16


def whole_tiles(rows: DataFrame, tile: list[str], kernel: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], schema: str, at_least: int = ROWS) -> DataFrame:
    """``kernel`` on columns of numbers of some whole tiles at a time, in order of tiles; rows of a tile are never parted."""

    def on_tables(tables: list[pa.Table], n: int | None = None) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(tables)
        table = table if n is None else table.slice(0, n)
        out = kernel({c: table.column(c).to_numpy() for c in table.column_names})
        # Lists without rows have no type.
        if any(map(len, out.values())):
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in out.values()], list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in (b.slice(k, at_least) for b in batches for k in range(0, b.num_rows, at_least)):
            held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) < at_least:
                continue
            table = pa.concat_tables(held).combine_chunks()
            # Rows before the last tile's first one.
            other = np.zeros(table.num_rows, bool)
            for c in tile:
                v = table.column(c).to_numpy()
                other |= v != v[-1]
            n = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            if n:
                yield from on_tables([table], n)
            held = [table.slice(n)]
        if held:
            yield from on_tables(held)

    # A stated number, as partitions small in bytes would be joined and their tiles solved by few tasks.
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *tile).sortWithinPartitions(*tile).mapInArrow(run, schema)


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For n nodes and edges (a, b): the smallest node that each is connected with."""
    parent = np.arange(n)
    while True:
        top_a, top_b = parent[a], parent[b]
        open_ = top_a != top_b
        if not open_.any():
            return parent
        a, b, top_a, top_b = a[open_], b[open_], top_a[open_], top_b[open_]
        np.minimum.at(parent, np.maximum(top_a, top_b), np.minimum(top_a, top_b))
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def places(*columns: np.ndarray) -> np.ndarray:
    """Number of each row among the different rows of the columns, in their order."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def overlaps(begin: np.ndarray, end: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of disjoint intervals in order, of which i moved on by ``shift`` meets j."""
    low = np.searchsorted(end, begin + shift, "left")
    high = np.searchsorted(begin, end + shift, "right")
    counts = np.maximum(high - low, 0)
    i = np.repeat(np.arange(len(begin)), counts)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)

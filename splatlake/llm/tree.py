"""Small summaries of partitions, merged in a tree of tasks."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Levels of the tree: with a million partitions the driver merges some thirty summaries.
DEPTH = 4


def tree_reduced(rows: DataFrame, summary: Callable[[Iterator[pa.RecordBatch]], object], merge: Callable, empty: object) -> object:
    """``summary`` of each partition's batches, merged pairwise by ``treeReduce``; ``empty`` where there are no partitions.

    Only summaries are shuffled, so their size must not depend on the rows.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(summary(batches))], pa.binary())], ["summary"])

    parts = rows.mapInArrow(one, "summary binary").rdd.map(lambda r: pickle.loads(bytes(r[0])))
    first = rows.sparkSession.sparkContext.parallelize([empty], 1)
    return first.union(parts).treeReduce(merge, DEPTH)

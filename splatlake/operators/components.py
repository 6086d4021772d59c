"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from splatlake.functions.storage import discard, written
from splatlake.operators.tiles import roots


def of_one_task(edges: DataFrame) -> DataFrame:
    """Components of few edges (u, v), by one task."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema([("u", pa.int64()), ("v", pa.int64())]))
        u, v = (table.column(c).to_numpy() for c in "uv")
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        found = roots(at[: len(u)], at[len(u) :], len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[found])], ["node", "component"])

    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(solve, "node long, component long")


def connected_components(edges: DataFrame, rounds: int = 40, one_task: int = 0) -> DataFrame:
    """(node, component) for all nodes of edges (a, b); the component is its smallest node.

    Each round hangs every node on the smallest of its neighbourhood, first those above it and then
    those below; the rounds needed grow with the logarithm of a component's size, not its diameter. The
    smallest neighbour is an aggregate (partial before the shuffle) joined back, so the edges of a node with very
    many neighbours stream through a merge join and are never held as a group. Each round is written
    to the shared folder in place of the one before. Edges with null ends and loops are left out. Once counted to be no more than
    ``one_task``, the edges that are left (of nodes that are whole numbers) are solved by one task at once.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), "a", "b")
    e = e.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select("u", "v").distinct()
    if one_task:
        count = Observation()
        e = written(e.observe(count, F.count(F.lit(1)).alias("n")), "edges")
        if count.get["n"] <= one_task:
            return of_one_task(e)
    else:
        e = written(e, "edges")
    before = None
    for _ in range(rounds):
        # Edges run from the larger node u to the smaller v, so v has a smaller neighbour if it is an edge's u.
        low = e.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = e.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        seen, last = Observation(), e
        e = small.union(low.select("u", F.col("m").alias("v"))).distinct()
        e = written(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("sum")), "edges")
        discard(last)
        now = seen.get
        if now == before:
            break
        if one_task and now["n"] <= one_task:
            return of_one_task(e)
        before = now
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

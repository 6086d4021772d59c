"""Exact top-k search by inner product, as a Voronoi kNN join.

Vectors become whole numbers, floor(256 x), so scores are exact, whatever the size of components. Each query is scaled to length M, the
longest vector's, and each data vector gets one more coordinate that lifts it to length M: the larger
the inner product, the smaller the distance, and the order of a query's candidates stays. Then:

1. A bounded sample of data vectors serves as pivots (half the root of their number, from ``PIVOTS`` least to
   most); queries and data go to the cell of the nearest.
2. A summary of each cell (largest distance of its queries; smallest distances of
   k + 1 different ids of its data) bounds the distance within which every query of the cell has k neighbours.
3. By the triangle inequality a data vector is needed by a group of query cells only if its distance
   to its own pivot lies in an interval for that group and cell; it is copied to just those groups. Of several
   numbers of groups the one is taken for which the summaries (with quantiles of the distances of each cell)
   promise the fewest copies and comparisons; ``plan_report`` has the share of copies for each.
4. Each (group, data block) is solved locally, and the best k of the blocks are merged by query.

Blocks hold a bounded number of vectors, by a hash of the row, so equal vectors, rows of one id or a crowded
cell do not meet in one task; query groups are cut into blocks too.

Defined results: vectors that are null or have null, NaN or infinite components take no part; shorter
vectors count as filled up with zeros; of repeated query ids one vector is kept (the smallest in byte
order), repeated data rows are candidates each, rows with the query's own id are not; ties go to the
smaller id; empty tables give no rows; extra columns are ignored. Scores beyond the range of long are given as its
nearest number, which then counts. Only components beyond 2**500 are refused, which single precision hasn't.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splatlake.llm.storage import written

PIVOTS = (16, 1024)
GROUPS = (1, 2, 4, 8, 16, 32, 64)
QUANTILES = 16
QUERY_BLOCK = 4096
DATA_BLOCK = 50_000
SCALE = 256


def _matrix(packed: pa.Array, width: int, kind: str) -> np.ndarray:
    """Rows of packed vectors, filled up with zeros to one width."""
    rows, size = packed.to_pylist(), np.dtype(kind).itemsize * width
    if all(len(r) == size for r in rows):
        return np.frombuffer(b"".join(rows), kind).reshape(-1, width)
    return np.frombuffer(b"".join(r.ljust(size, b"\0") for r in rows), kind).reshape(-1, width)


def whole_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, packed (whole components as doubles, which hold them exactly), width, norm2, largest (component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep: tuple[list, ...] = ([], [], [], [], [])
            lists = batch.column(1)
            values, sizes = pc.list_flatten(lists), pc.list_value_length(lists).fill_null(-1).to_numpy(zero_copy_only=False)
            missing = pc.is_null(values).to_numpy(zero_copy_only=False)
            flat = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
            good = np.isfinite(flat) & ~missing
            flat = np.where(good, flat, 0)
            if (np.abs(flat) > 2.0**500).any():
                raise ValueError("a component is beyond 2**500")
            whole = np.floor(SCALE * flat).astype("<f8") + 0.0  # no negative zeros
            at = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])
            ids = batch.column(0)
            for k in np.flatnonzero((sizes >= 0) & ids.is_valid().to_numpy(zero_copy_only=False)).tolist():
                if good[at[k] : at[k + 1]].all():
                    v = whole[at[k] : at[k + 1]]
                    for to, x in zip(keep, (ids[k].as_py(), v.tobytes(), len(v), float((v**2).sum()), float(np.abs(v).max(initial=0))), strict=True):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(keep, (pa.int64(), pa.binary(), pa.int32(), pa.float64(), pa.float64()), strict=True)], ["vec_id", "packed", "width", "norm2", "largest"])

    return table.select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(run, "vec_id long, packed binary, width int, norm2 double, largest double")


class Space:
    """Lifted vectors and distances to pivots."""

    def __init__(self, width: int, longest2: float, pivots: np.ndarray):
        self.width, self.longest2 = width, longest2
        self.pivots = self.data(pivots)

    def data(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.column_stack([x, np.sqrt(np.maximum(0, self.longest2 - (x**2).sum(1)))])

    def queries(self, q: np.ndarray) -> np.ndarray:
        q = q.astype(np.float64)
        norm = np.sqrt((q**2).sum(1))
        return np.column_stack([q * np.where(norm > 0, np.sqrt(self.longest2) / np.maximum(norm, 1e-300), 0)[:, None], np.zeros(len(q))])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d2 = (x**2).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * x @ self.pivots.T
        cell = d2.argmin(1)
        return cell, np.sqrt(((x - self.pivots[cell]) ** 2).sum(1))


def _cells(vectors: DataFrame, shared, query: bool, kind: str) -> DataFrame:
    """Add cell and distance to its pivot; components are packed anew as ``kind``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        for batch in batches:
            x = _matrix(batch.column(1), space.width, "<f8")
            cell, distance = space.nearest(space.queries(x) if query else space.data(x))
            packed = pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, pa.array(cell, pa.int32()), pa.array(distance)], ["vec_id", "packed", "cell", "distance"])

    return vectors.select("vec_id", "packed").mapInArrow(run, "vec_id long, packed binary, cell int, distance double")


@dataclass
class Plan:
    """Group of each query cell; for [group, data cell] the interval of pivot distances that the group needs; expected copies and comparisons."""

    group: np.ndarray
    low: np.ndarray
    high: np.ndarray
    copies: float = 0.0
    compared: float = 0.0


def _bounds(space: Space, reach: dict[int, float], data: dict[int, list[tuple[float, int]]], k: int) -> tuple[np.ndarray, dict[int, float]]:
    """Distances between pivots; for each query cell the distance within which all its queries have k neighbours."""
    apart = np.sqrt(np.maximum(0, ((space.pivots[:, None] - space.pivots[None]) ** 2).sum(2)))
    cell = np.array([j for j, nearest in data.items() for _ in nearest], int)
    distance, own = (np.array([x[i] for nearest in data.values() for x in nearest]) for i in (0, 1))
    out = {}
    for i, r in reach.items():
        order = np.argsort(r + apart[i, cell] + distance, kind="stable")
        _, first = np.unique(own[order], return_index=True)  # the nearest row of each id
        first.sort()
        # k + 1 different ids, as rows with the query's own id don't count.
        out[i] = float((r + apart[i, cell] + distance)[order[first[k]]]) if len(first) > k else np.inf
    return apart, out


def _plan(space: Space, apart: np.ndarray, reach: dict[int, float], bound: dict[int, float], groups: int) -> Plan:
    n = len(space.pivots)
    slack = 1e-6 * (1 + np.sqrt(space.longest2))  # for rounding in the distances
    # Query cells close to each other share a group: in the order of their distance to the first cell.
    cells = sorted(reach)
    order = sorted(cells, key=lambda i: apart[cells[0], i])
    group = np.full(n, -1)
    for place, i in enumerate(order):
        group[i] = place * min(groups, len(order)) // len(order)
    low, high = np.full((groups, n), np.inf), np.full((groups, n), -np.inf)
    for i in cells:
        low[group[i]] = np.minimum(low[group[i]], apart[i] - reach[i] - bound[i] - slack)
        high[group[i]] = np.maximum(high[group[i]], apart[i] + reach[i] + bound[i] + slack)
    return Plan(group, low, high)


def _weighed(plan: Plan, asked: dict[int, int], spread: dict[int, tuple[int, np.ndarray]]) -> Plan:
    """With expected copies and comparisons. asked: queries of each cell; spread: rows and quantiles of distances of each data cell."""
    queries = np.zeros(len(plan.low))
    for i, n in asked.items():
        queries[plan.group[i]] += n
    for j, (n, marks) in spread.items():
        inside = ((plan.low[:, j, None] <= marks) & (marks <= plan.high[:, j, None])).mean(1) * n
        plan.copies += float(inside.sum())
        plan.compared += float((inside * queries).sum())
    return plan


def _prepared(data: DataFrame, queries: DataFrame, k: int, pivots: int | None, groups: int | None):
    """Vectors with cells, and plans for several numbers of groups; None if there is nothing to search."""
    spark = data.sparkSession
    vectors = written(whole_vectors(data), "vectors")
    asked = written(whole_vectors(queries).groupBy("vec_id").agg(F.min_by(F.struct("packed", "width", "largest"), "packed").alias("v")).select("vec_id", "v.*"), "queries")
    n, width, longest2, largest = vectors.agg(F.count("*"), F.max("width"), F.max("norm2"), F.max("largest")).head()
    n_queries, query_width, query_largest = asked.agg(F.count("*"), F.max("width"), F.max("largest")).head()
    if not n or not n_queries:
        return None
    width, kind = max(width, query_width, 1), "<i4" if max(largest, query_largest) < 1 << 31 else "<f8"
    pivots = pivots or int(np.clip(n**0.5 / 2, *PIVOTS))
    chosen = vectors.orderBy(F.xxhash64("vec_id", "packed"), "vec_id").limit(pivots).select("packed").collect()
    points = np.unique(_matrix(pa.array([bytes(r[0]) for r in chosen], pa.binary()), width, "<f8"), axis=0)
    space = Space(width, longest2, points)
    shared = spark.sparkContext.broadcast(space)
    data_cells, query_cells = written(_cells(vectors, shared, False, kind), "cells"), written(_cells(asked, shared, True, kind), "query-cells")
    # Summaries: a row for each pivot, and distances of k + 1 ids.
    found = query_cells.groupBy("cell").agg(F.max("distance"), F.count("*")).collect()
    reach, asks = {r[0]: r[1] for r in found}, {r[0]: r[2] for r in found}
    nth = F.row_number().over(Window.partitionBy("cell").orderBy("distance", "vec_id"))
    summary: dict[int, list[tuple[float, int]]] = {}
    for r in data_cells.groupBy("cell", "vec_id").agg(F.min("distance").alias("distance")).withColumn("nth", nth).where(F.col("nth") <= k + 1).collect():
        summary.setdefault(r["cell"], []).append((r["distance"], r["vec_id"]))
    marks = [(q + 0.5) / QUANTILES for q in range(QUANTILES)]
    spread = {r[0]: (r[1], np.array(r[2])) for r in data_cells.groupBy("cell").agg(F.count("*"), F.percentile_approx("distance", marks, 1000)).collect()}
    apart, bound = _bounds(space, reach, summary, k)
    plans = [_weighed(_plan(space, apart, reach, bound, g), asks, spread) for g in ((groups,) if groups else GROUPS)]
    return data_cells, query_cells, plans, n, n_queries, width, kind


def plan_report(data: DataFrame, queries: DataFrame, k: int = 5) -> list[tuple[int, float, float]]:
    """For each number of groups: copies of a data vector, and the share of all (query, vector) pairs compared, as expected."""
    ready = _prepared(data, queries, k, None, None)
    return [(len(p.low), p.copies / ready[3], p.compared / ready[3] / ready[4]) for p in ready[2]] if ready else []


def knn_join(data: DataFrame, queries: DataFrame, k: int = 5, pivots: int | None = None, groups: int | None = None) -> DataFrame:
    """The k data vectors of largest inner product for each query: query_id, rank, vec_id, score."""
    spark = data.sparkSession
    ready = _prepared(data, queries, k, pivots, groups)
    if not ready:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    data_cells, query_cells, plans, n, n_queries, width, kind = ready
    best = min(plans, key=lambda p: p.copies + p.compared / QUERY_BLOCK)
    group = best.group
    bounds = spark.sparkContext.broadcast((best.low, best.high))
    n_blocks, n_query_blocks = -(-n // DATA_BLOCK), -(-n_queries // QUERY_BLOCK)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = bounds.value
        seen = 0
        for batch in batches:
            cell, distance = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            row, to = np.nonzero((low[:, cell].T <= distance[:, None]) & (distance[:, None] <= high[:, cell].T))
            for a in range(0, len(row), 20_000):
                own = pa.array(row[a : a + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(to[a : a + 20_000], pa.int32()), batch.column(0).take(own), batch.column(1).take(own), pa.array(seen + row[a : a + 20_000], pa.int64())], ["team", "vec_id", "packed", "salt"])
            seen += batch.num_rows

    copies = data_cells.mapInArrow(copy, "team int, vec_id long, packed binary, salt long").withColumn("block", F.pmod(F.xxhash64("vec_id", "salt"), F.lit(n_blocks)))
    team = F.element_at(F.array(*[F.lit(int(g)) for g in group]), F.col("cell") + 1)
    asking = query_cells.select(team.alias("team"), "vec_id", "packed", F.pmod(F.xxhash64("vec_id"), F.lit(n_query_blocks)).alias("part"))
    if n_query_blocks > 1:
        copies = copies.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1))))
    else:
        copies = copies.withColumn("part", F.lit(0))
    asking = asking.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn("part", F.col("part").cast("int"))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        return _local(left, right, width, k, kind)

    keys = ("team", "part", "block")
    copies, asking = (x.select(F.col("team").cast("int"), F.col("part").cast("int"), F.col("block").cast("int"), "vec_id", "packed") for x in (copies, asking))
    found = asking.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _local(left: pa.Table, right: pa.Table, width: int, k: int, kind: str) -> pa.Table:
    """Best k of the data (right) for each query (left)."""
    out: tuple[list, ...] = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
    if left.num_rows and right.num_rows:
        ids = right["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], _matrix(right["packed"].combine_chunks(), width, kind)[order]
        asks, q = left["vec_id"].to_numpy(), _matrix(left["packed"].combine_chunks(), width, kind)
        largest = [float(np.abs(m.astype(float)).max(initial=0)) for m in (x, q)]
        product = largest[0] * largest[1] * width
        if product < 1 << 52:
            x, q = x.astype(float), q.astype(float)
        elif product < 1 << 62 and max(largest) < 1 << 62:
            x, q = x.astype(np.int64), q.astype(np.int64)
        else:  # Python's whole numbers
            x, q = (np.array([[int(v) for v in row] for row in m.tolist()], object).reshape(m.shape) for m in (x, q))
        step = max(1, 4_000_000 // len(ids))
        for a in range(0, len(asks), step):
            score = q[a : a + step] @ x.T
            score = (np.clip(score, -(1 << 63), (1 << 63) - 1) if score.dtype == object else score).astype(np.int64)
            own = asks[a : a + step]
            best = np.full((len(own), k), -1)
            for r in range(len(own)):
                line = score[r]
                first, last = np.searchsorted(ids, own[r], "left"), np.searchsorted(ids, own[r], "right")
                allowed = len(ids) - (last - first)
                want = min(k, allowed)
                if not want:
                    continue
                # Of the ids in order, those that reach the (k + own rows)-th largest score.
                take = min(len(ids), want + last - first)
                edge = np.partition(line, len(ids) - take)[len(ids) - take]
                near = np.flatnonzero(line >= edge)
                near = near[(near < first) | (near >= last)]
                best[r, :want] = near[np.argsort(-line[near], kind="stable")[:want]]
            r, c = np.nonzero(best >= 0)
            out[0].append(own[r])
            out[1].append(ids[best[r, c]])
            out[2].append(score[r, best[r, c]])
    return pa.table([np.concatenate(x) for x in out], names=["query_id", "vec_id", "score"])

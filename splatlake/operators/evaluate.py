"""Distances between splats and meshes, dense row numbers, and picking."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splatlake.functions import expr as X
from splatlake.functions.storage import written

SAMPLE = 4096


def dense_index(df: DataFrame, order: str, name: str = "row") -> DataFrame:
    """Row numbers from 0 in the order of a column: range partitions are counted and then numbered side by side."""
    ranged = written(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("part", F.spark_partition_id()), "ranged")
    counts = sorted(ranged.groupBy("part").count().collect())  # one row for each partition
    starts, total = {}, 0
    for part, n in counts:
        starts[part] = total
        total += n
    begin = F.element_at(F.create_map(*[F.lit(v) for kv in starts.items() for v in kv]), F.col("part")) if starts else F.lit(0)
    return ranged.withColumn(name, begin + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1).drop("part")


def stride_sample(splats: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Every stride-th splat in order of id, at most ``most``."""
    indexed = dense_index(splats.select("splat_id", "x", "y", "z"), "splat_id")
    n = indexed.count()
    target = min(n, most)
    stride = max(n // max(target, 1), 1)
    return indexed.where((F.col("row") % stride == 0) & (F.col("row") < stride * target)).drop("row")


def triangle_distances(points: np.ndarray, triangles: np.ndarray) -> np.ndarray:
    """Distances [point, triangle], by the regions of a triangle's plane (Ericson)."""
    a, b, c = (triangles[None, :, k : k + 3] for k in (0, 3, 6))
    p = points[:, None, :]
    ab, ac = b - a, c - a
    dot = lambda u, v: (u * v).sum(-1)
    d1, d2, d3, d4, d5, d6 = dot(ab, p - a), dot(ac, p - a), dot(ab, p - b), dot(ac, p - b), dot(ab, p - c), dot(ac, p - c)
    va, vb, vc = d3 * d6 - d5 * d4, d5 * d2 - d1 * d6, d1 * d4 - d3 * d2
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = 1 / (va + vb + vc)
        places = [
            ((d1 <= 0) & (d2 <= 0), np.zeros_like(d1), np.zeros_like(d1)),
            ((d3 >= 0) & (d4 <= d3), np.ones_like(d1), np.zeros_like(d1)),
            ((vc <= 0) & (d1 >= 0) & (d3 <= 0), d1 / (d1 - d3), np.zeros_like(d1)),
            ((d6 >= 0) & (d5 <= d6), np.zeros_like(d1), np.ones_like(d1)),
            ((vb <= 0) & (d2 >= 0) & (d6 <= 0), np.zeros_like(d1), d2 / (d2 - d6)),
            ((va <= 0) & (d4 - d3 >= 0) & (d5 - d6 >= 0), 1 - (d4 - d3) / ((d4 - d3) + (d5 - d6)), (d4 - d3) / ((d4 - d3) + (d5 - d6))),
        ]
        v, w = vb * inner, vc * inner
        for where, vv, ww in reversed(places):
            v, w = np.where(where, vv, v), np.where(where, ww, w)
        nearest = a + ab * v[..., None] + ac * w[..., None]
    return np.sqrt(((p - nearest) ** 2).sum(-1))


def point_errors(points: DataFrame, mesh: DataFrame) -> DataFrame:
    """splat_id and distance to the mesh, for a sample of at most ``SAMPLE`` points (no rows for an empty mesh).

    The sample is broadcast; triangles stream past it in blocks, and each task sends its minima only.
    """
    rows = points.select("splat_id", "x", "y", "z").limit(SAMPLE + 1).collect()
    if len(rows) > SAMPLE:
        raise ValueError(f"over {SAMPLE} points")
    sample = points.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([list(r)[1:] for r in rows], float).reshape(-1, 3)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, p = sample.value
        best = np.full(len(ids), np.inf)
        for batch in batches:
            t = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(9)])
            step = max(1, 500_000 // max(1, len(ids)))
            for k in range(0, len(t), step):
                if len(ids):
                    best = np.minimum(best, triangle_distances(p, t[k : k + step]).min(1))
        found = np.isfinite(best)
        yield pa.RecordBatch.from_arrays([pa.array(ids[found]), pa.array(best[found])], ["splat_id", "distance"])

    from splatlake.operators.mesh import CORNERS

    return mesh.select(*CORNERS).mapInArrow(run, "splat_id long, distance double").groupBy("splat_id").agg(F.min("distance").alias("distance"))


def error_summary(errors: DataFrame) -> DataFrame:
    """sample_count, mean, rms and nearest-rank 95th percentile, by ranks over range partitions; zeros without samples."""
    indexed = dense_index(errors.select("distance"), "distance")
    at = math.floor((indexed.count() - 1) * 0.95 + 0.5)
    d, zero = F.col("distance"), F.lit(0.0)
    return indexed.agg(
        F.count("*").cast("int").alias("sample_count"), F.coalesce(F.avg(d), zero).alias("mean"), F.coalesce(F.sqrt(F.avg(d * d)), zero).alias("rms"), F.coalesce(F.max(F.when(F.col("row") == at, d)), zero).alias("p95")
    )


def pick(splats: DataFrame, origin: tuple, direction: tuple, near: float = 0.05) -> DataFrame:
    """The splat a ray meets first within ``near``, or else the one nearest to the ray ahead of its origin."""
    off = [X.d(c) - o for c, o in zip("xyz", origin, strict=True)]
    size2 = sum(v * v for v in direction)
    t = sum((o * v for o, v in zip(off, direction, strict=True)), F.lit(0.0)) / size2
    out = splats.select("splat_id", "x", "y", "z", t.alias("t")).where("t >= 0")
    miss = [X.d(c) - (F.lit(o) + F.col("t") * v) for c, o, v in zip("xyz", origin, direction, strict=True)]
    out = out.withColumn("d2", X.dot(miss, miss))
    point = F.struct("splat_id", "x", "y", "z")
    hit = F.min_by(point, F.when(F.col("d2") <= near * near, F.struct("t", "splat_id")))
    best = F.coalesce(F.when(F.count_if(F.col("d2") <= near * near) > 0, hit), F.min_by(point, F.struct("d2", "splat_id")))
    return out.agg(best.alias("p")).select("p.*")

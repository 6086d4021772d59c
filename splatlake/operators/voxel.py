"""Voxel occupancy of splats, and filters by connected or contributing cells."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splatlake.functions import expr as X
from splatlake.operators.components import connected_components
from splatlake.operators.filters import scene_bounds
from splatlake.operators.tiles import overlaps, places, roots, whole_tiles

#: Cells of a tile along x, y and z: at most half a million runs.
TILE = (1024, 32, 32)
#: Cells of a tile that is looked at with the cells around it.
NEAR_TILE = (64, 32, 32)
#: Edges between tiles that one task may solve.
ONE_TASK_EDGES = 1 << 20


@dataclass(frozen=True)
class Grid:
    """Origin, cell size and number of cells on each axis; solid cells are a table (cx, cy, cz)."""

    origin: tuple
    size: float
    dims: tuple

    @property
    def nx(self) -> int:
        return self.dims[0]

    @property
    def ny(self) -> int:
        return self.dims[1]

    @property
    def nz(self) -> int:
        return self.dims[2]

    @property
    def cell_count(self) -> int:
        return self.nx * self.ny * self.nz

    def cell_of(self, p: tuple) -> tuple | None:
        """Cell of a point; None outside."""
        c = tuple(math.floor((v - o) / self.size) if math.isfinite(v) else -1 for v, o in zip(p, self.origin, strict=True))
        return c if all(0 <= i < n for i, n in zip(c, self.dims, strict=True)) else None

    def clamped_cell_of(self, p: tuple) -> tuple:
        return tuple(0 if n <= 1 or not math.isfinite(v) else min(max(math.floor((v - o) / self.size), 0), n - 1) for v, o, n in zip(p, self.origin, self.dims, strict=True))

    def centre(self, cell: list[Column]) -> list[Column]:
        return [o + (c + 0.5) * self.size for o, c in zip(self.origin, cell, strict=True)]


def grid_of(splats: DataFrame, size: float) -> Grid:
    """Grid around all boxes of three deviations, out to multiples of four cells; one aggregate row is read.

    The header is computed in single precision, as the number of cells of some sizes depends on it.
    """
    if not size > 0:
        raise ValueError("the voxel size must be positive")
    r = scene_bounds(splats).head()
    if r["min_x"] is None:
        return Grid((0.0, 0.0, 0.0), size, (1, 1, 1))
    s, block = np.float32(size), np.float32(size) * np.float32(4)
    low = [np.floor(np.float32(r[f"min_{c}"]) / block) * block for c in "xyz"]
    high = [np.ceil(np.float32(r[f"max_{c}"]) / block) * block for c in "xyz"]
    return Grid(tuple(float(v) for v in low), size, tuple(max(1, int(np.ceil((b - a) / s))) for a, b in zip(low, high, strict=True)))


def _prepared(splats: DataFrame, grid: Grid, threshold: float, keep: list[str]) -> DataFrame:
    """Splats that can reach the threshold, with matrix, deviations and cell ranges.

    A corner of the three-deviation box that lies outside on any axis makes the whole corner that of the
    grid. Cells beyond the distance at which the contribution falls under the threshold are left out of
    the candidates (a<axis>..b<axis>), not of the covered range (lo_*, hi_*).
    """
    base = splats.where(~F.isnan(X.d("opacity"))).where(X.alpha() >= threshold)
    base = X.computed(base, keep + [c for c in ("scale_0", "scale_1", "scale_2", "opacity") if c not in keep], {f"u{i}": c for i, c in enumerate(X.unit_quaternion())} | {f"p{c}": X.d(c) for c in "xyz"})
    m = X.matrix([F.col(f"u{i}") for i in range(4)])
    base = X.computed(base, keep + ["px", "py", "pz"], {"alpha": X.alpha()} | {f"m{i}{j}": m[i][j] for i in range(3) for j in range(3)} | {f"e{i}": F.exp(X.d(f"scale_{i}")) for i in range(3)})
    m = [[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)]
    sigma = [F.col(f"e{i}") for i in range(3)]
    reach = F.sqrt(2 * F.log(F.col("alpha") / threshold)) if threshold > 0 else F.lit(float("inf"))
    wide = X.half_extents(m, sigma)
    tight = X.half_extents(m, [F.greatest(s, F.lit(X.MIN_SIGMA)) for s in sigma], reach)
    cell = lambda v, k: F.floor((v - grid.origin[k]) / grid.size)
    own = keep + ["px", "py", "pz", "alpha", *[f"m{i}{j}" for i in range(3) for j in range(3)], "e0", "e1", "e2"]
    near = {f"{n}{k}": cell(F.col(f"p{c}") + s * (tight[k] * 1.0000001 + 1e-9), k) if threshold > 0 else F.lit(v).cast("long") for n, s, v in (("a", -1, 0), ("b", 1, 1 << 40)) for k, c in enumerate("xyz")}
    out = X.computed(base, own, {f"{n}{k}": cell(F.col(f"p{c}") + s * wide[k], k) for n, s in (("lo", -1), ("hi", 1)) for k, c in enumerate("xyz")} | near)
    cells = {}
    for name, edges in (("lo", (0, 0, 0)), ("hi", tuple(n - 1 for n in grid.dims))):
        inside = reduce(lambda a, b: a & b, [(F.col(f"{name}{k}") >= 0) & (F.col(f"{name}{k}") < grid.dims[k]) for k in range(3)])
        cells |= {f"{name}{k}": F.when(inside, F.col(f"{name}{k}")).otherwise(F.lit(edges[k])) for k in range(3)}
    out = X.computed(out, own, cells | {f"a{k}": F.greatest(f"a{k}", cells[f"lo{k}"]) for k in range(3)} | {f"b{k}": F.least(f"b{k}", cells[f"hi{k}"]) for k in range(3)})
    return out.where("a0 <= b0 AND a1 <= b1 AND a2 <= b2")


def contributions(splats: DataFrame, grid: Grid, threshold: float, keep: list[str] | None = None) -> DataFrame:
    """One row for each splat and cell in its range that it may reach: keep columns, cx, cy, cz, contribution."""
    keep = ["splat_id"] if keep is None else keep
    out = _prepared(splats, grid, threshold, keep)
    for k, c in ((2, "cz"), (1, "cy"), (0, "cx")):
        out = out.withColumn(c, F.explode(F.sequence(F.col(f"a{k}").cast("int"), F.col(f"b{k}").cast("int"))))
    centre = grid.centre([F.col("cx"), F.col("cy"), F.col("cz")])
    m = [[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)]
    sigma = [F.greatest(F.col(f"e{i}"), F.lit(X.MIN_SIGMA)) for i in range(3)]
    d2 = X.mahalanobis2(m, sigma, X.minus(centre, [F.col(f"p{c}") for c in "xyz"]))
    return out.select(*keep, "cx", "cy", "cz", (F.col("alpha") * F.exp(-0.5 * d2)).alias("contribution"))


def solid_cells(splats: DataFrame, grid: Grid, threshold: float) -> DataFrame:
    """Cells to whose centre some splat contributes the threshold or more; repeats are dropped before the shuffle too, by one number for a cell."""
    hits = contributions(splats, grid, threshold, []).where(F.col("contribution") >= threshold)
    keys = hits.select(X.cell_key(grid, F.col("cx"), F.col("cy"), F.col("cz")).alias("cell")).distinct()
    part = lambda c: c.cast("int")
    keys = keys.select("cell", F.expr(f"cell div {grid.nx}").alias("row"))
    return keys.select(part(F.col("cell") - F.col("row") * grid.nx).alias("cx"), part(F.col("row") % grid.ny).alias("cy"), part(F.expr(f"row div {grid.ny}")).alias("cz"))


def mismatch_count(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells solid in just one of two grids of the same shape."""
    both = a.select("cx", "cy", "cz", F.lit(1).alias("side")).union(b.select("cx", "cy", "cz", F.lit(2).alias("side")))
    return both.groupBy("cx", "cy", "cz").agg(F.sum("side").alias("sides")).agg(F.count_if(F.col("sides") != 3).alias("mismatches"))


STEPS = [(-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)]


def neighbours(cells: DataFrame) -> DataFrame:
    """Cells with each of their six neighbours (nx, ny, nz), also outside the grid."""
    steps = F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy"), F.lit(z).alias("dz")) for x, y, z in STEPS])
    return cells.withColumn("step", F.explode(steps)).select("*", (F.col("cx") + F.col("step.dx")).alias("nx"), (F.col("cy") + F.col("step.dy")).alias("ny"), (F.col("cz") + F.col("step.dz")).alias("nz")).drop("step")


def with_rings(cells: DataFrame, reach: tuple, dims: tuple | None = None) -> DataFrame:
    """Cells with every tile (tx, ty, tz) of ``NEAR_TILE`` cells that they lie in or within ``reach`` of; of a grid of ``dims`` cells, its tiles only."""
    out = cells.select(*[F.col(c).cast("int").alias(c) for c in ("cx", "cy", "cz")])
    for k, c in enumerate("xyz"):
        low, high = (F.floor((F.col(f"c{c}") + s * reach[k]) / NEAR_TILE[k]).cast("int") for s in (-1, 1))
        if dims:
            low, high = F.greatest(low, F.lit(0)), F.least(high, F.lit((dims[k] - 1) // NEAR_TILE[k]))
            out = out.where(low <= high)
        out = out.withColumn(f"t{c}", F.explode(F.sequence(low, high)))
    return out


def nearest_solid(cells: DataFrame, seed: tuple) -> tuple | None:
    """Solid cell nearest to a cell; ties in order of z, y, x."""
    off = [F.col(c).cast("long") - v for c, v in zip(("cx", "cy", "cz"), seed, strict=True)]
    d2 = X.dot(off, off)
    r = cells.orderBy(d2, "cz", "cy", "cx").limit(1).collect()
    return (r[0]["cx"], r[0]["cy"], r[0]["cz"]) if r else None


def x_runs(cells: DataFrame) -> DataFrame:
    """Maximal runs along x: cy, cz, x0, x1."""
    from pyspark.sql import Window

    w = Window.partitionBy("cy", "cz").orderBy("cx")
    return cells.select("cx", "cy", "cz", (F.col("cx") - F.row_number().over(w)).alias("run")).groupBy("cy", "cz", "run").agg(F.min("cx").alias("x0"), F.max("cx").alias("x1")).drop("run")


def expand_runs(runs: DataFrame) -> DataFrame:
    return runs.select(F.explode(F.sequence(F.col("x0").cast("int"), F.col("x1").cast("int"))).alias("cx"), "cy", "cz")


def _tile_runs(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Runs of some tiles with ``root``, the smallest id of a run that each is connected with inside its tile."""
    nx, ny, nz = TILE
    tile = places(columns["tx"], columns["ty"], columns["tz"])
    row = (tile * (nz + 1) + columns["cz"] % nz) * (ny + 1) + columns["cy"] % ny
    begin, end = (row * (nx + 1) + columns[c] % nx for c in ("x0", "x1"))
    order = np.argsort(begin)
    begin, end = begin[order], end[order]
    # A row and a layer of each tile are kept free, so that nothing meets what is not beside it.
    (i, j), (k, m) = overlaps(begin, end, nx + 1), overlaps(begin, end, (nx + 1) * (ny + 1))
    ids = columns["id"][order]
    by_id = np.argsort(ids)
    nth = np.empty_like(by_id)
    nth[by_id] = np.arange(len(ids))
    found = roots(nth[np.concatenate([i, k])], nth[np.concatenate([j, m])], len(ids))
    return {c: columns[c][order] for c in ("cy", "cz", "x0", "x1", "id")} | {"root": ids[by_id][found[nth]]}


def tile_runs(runs: DataFrame, grid: Grid) -> DataFrame:
    """Runs, cut where tiles of ``TILE`` cells end, with id (flat index of the first cell) and root (smallest id connected inside the tile)."""
    nx, ny, nz = TILE
    cut = runs.withColumn("tx", F.explode(F.sequence(F.floor(F.col("x0") / nx).cast("int"), F.floor(F.col("x1") / nx).cast("int"))))
    cut = cut.select("tx", F.floor(F.col("cy") / ny).cast("int").alias("ty"), F.floor(F.col("cz") / nz).cast("int").alias("tz"), F.col("cy").cast("int"), F.col("cz").cast("int"), F.greatest(F.col("x0"), F.col("tx") * nx).cast("int").alias("x0"), F.least(F.col("x1"), F.col("tx") * nx + nx - 1).cast("int").alias("x1"))
    cut = cut.withColumn("id", X.cell_key(grid, F.col("x0"), F.col("cy"), F.col("cz")))
    return whole_tiles(cut, ["tx", "ty", "tz"], _tile_runs, "cy int, cz int, x0 int, x1 int, id long, root long")


def tile_edges(runs: DataFrame) -> DataFrame:
    """Edges (a, b) between roots whose runs touch across the sides of tiles."""
    nx, ny, nz = TILE
    tx = F.floor(F.col("x0") / nx).cast("int").alias("tx")
    last = lambda c, n: F.col(c) % n == n - 1
    side = lambda y, z, x, o0, o1: F.struct((F.col("cy") + y).alias("cy"), (F.col("cz") + z).alias("cz"), (tx + x).alias("tx"), o0.alias("o0"), o1.alias("o1"))
    sides = [F.when(last("cy", ny), side(1, 0, 0, F.col("x0"), F.col("x1"))), F.when(last("cz", nz), side(0, 1, 0, F.col("x0"), F.col("x1"))), F.when(last("x1", nx), side(0, 0, 1, F.col("x1") + 1, F.col("x1") + 1))]
    here = runs.where(last("cy", ny) | last("cz", nz) | last("x1", nx)).select(F.explode(F.array_compact(F.array(*sides))).alias("s"), F.col("root").alias("a")).select("s.*", "a")
    there = runs.where((F.col("cy") % ny == 0) | (F.col("cz") % nz == 0) | (F.col("x0") % nx == 0)).select("cy", "cz", tx, "x0", "x1", F.col("root").alias("b"))
    return here.join(there, ["cy", "cz", "tx"]).where("x0 <= o1 AND o0 <= x1").select("a", "b")


def labelled_runs(runs: DataFrame, grid: Grid, more_edges: DataFrame | None = None, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """Runs (cut at tiles) with ``component``, the smallest run id connected to each.

    Tiles are solved by a task each; the star rounds see only edges between tiles, and ``more_edges`` (a: an id of a run).
    """
    from splatlake.functions.storage import written

    runs = written(tile_runs(runs, grid), "runs")
    edges = tile_edges(runs)
    if more_edges is not None:
        edges = edges.union(more_edges.join(runs.select(F.col("id").alias("a"), "root"), "a").select("root", "b"))
    found = connected_components(edges, one_task=one_task)
    return runs.join(found, runs["root"] == found["node"], "left").withColumn("component", F.coalesce("component", "root")).drop("node", "root")


def component_of(cells: DataFrame, grid: Grid, seed: tuple) -> DataFrame:
    """Cells connected with the seed over faces (none if the seed is not among them)."""
    runs = labelled_runs(x_runs(cells), grid)
    own = runs.where((F.col("cy") == seed[1]) & (F.col("cz") == seed[2]) & (F.col("x0") <= seed[0]) & (F.col("x1") >= seed[0])).select("component")
    return expand_runs(runs.join(F.broadcast(own), "component", "left_semi"))  # the seed lies in one run at most


@dataclass
class ClusterResult:
    splats: DataFrame
    requested: tuple
    resolved: tuple
    grid: Grid
    component: DataFrame


def cluster_filter(splats: DataFrame, coarse: float, threshold: float, seed: tuple, least: float = 0.1) -> ClusterResult:
    """Splats of the cluster of coarse cells that holds the seed.

    A splat stays if its alpha reaches ``least`` and its centre's cell is in the cluster, or if it
    contributes ``least`` to enough of the cluster's cells: to one, or to a sixteenth of its covered
    range (two at least) if that has over 64 cells.
    """
    if not coarse > 0 or not 0 <= threshold <= 1 or not least >= 0:
        raise ValueError("bad parameters of a cluster filter")
    from splatlake.functions.storage import written

    grid = grid_of(splats, coarse)
    low = min(threshold, least)
    reached = written(contributions(splats, grid, low).where(F.col("contribution") >= low), "contributions")
    cells = written(reached.where(F.col("contribution") >= threshold).select("cx", "cy", "cz").distinct(), "cells")
    asked = grid.clamped_cell_of(seed)
    found = nearest_solid(cells, asked)
    if found is None:
        raise ValueError("no occupied voxel for the cluster filter")
    own = component_of(cells, grid, found)
    ids = cluster_members(splats, grid, own, least, reached)
    return ClusterResult(splats.join(ids, "splat_id", "left_semi"), asked, found, grid, own)


def cluster_members(splats: DataFrame, grid: Grid, component: DataFrame, least: float, reached: DataFrame | None = None) -> DataFrame:
    """splat_id of the splats that belong to a component; ``reached`` has their contributions of ``least`` and more, if these are at hand."""
    bright = splats.where(~F.isnan(X.d("opacity")) & (X.alpha() >= least))
    centre = bright.select("splat_id", *[F.floor((X.d(c) - o) / grid.size).cast("int").alias(n) for c, n, o in zip("xyz", ("cx", "cy", "cz"), grid.origin, strict=True)])
    by_centre = centre.join(component, ["cx", "cy", "cz"], "left_semi").select("splat_id")
    covered = _prepared(splats, grid, least, ["splat_id"]).select("splat_id", ((F.col("hi0") - F.col("lo0") + 1) * (F.col("hi1") - F.col("lo1") + 1) * (F.col("hi2") - F.col("lo2") + 1)).alias("covered"))
    need = F.when(F.col("covered") > 64, F.greatest(F.floor(F.col("covered") / 16), F.lit(2))).otherwise(1)
    reached = contributions(splats, grid, least) if reached is None else reached
    hits = reached.where(F.col("contribution") >= least).join(component, ["cx", "cy", "cz"], "left_semi").groupBy("splat_id").agg(F.count("*").alias("hits"))
    by_hits = hits.join(covered, "splat_id").where(F.col("hits") >= need).select("splat_id")
    return by_centre.union(by_hits).distinct()


def floater_filter(splats: DataFrame, cells: DataFrame, grid: Grid, threshold: float, least: float = 0.1) -> DataFrame:
    """Splats that contribute both the threshold and ``least`` to some solid cell."""
    enough = max(threshold, least)
    near = contributions(splats, grid, threshold).where(F.col("contribution") >= enough).join(cells, ["cx", "cy", "cz"], "left_semi")
    return splats.join(near.select("splat_id").distinct(), "splat_id", "left_semi")

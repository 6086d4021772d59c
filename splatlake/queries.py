"""Queries over the test tables, one for each operator, with the same results in DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splatlake.functions import expr as X
from splatlake.operators import evaluate, filters, mesh, morph, navmesh, sog, voxel
from splatlake.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SIZE, THRESHOLD = 0.25, 0.1
SCALARS = ["splat_id", *X.SCALARS]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def six(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def q6(s: str, name: str) -> str:
    return f"round({s}, 6) + 0.0 AS {name}"


def emb(spark: SparkSession, sf: str) -> DataFrame:
    return T.splats_from_embeddings(spark, sf)


def turned(rows: str) -> str:
    """SQL: columns of ``rows`` with matrix m00..m22, deviations e0..e2 and alpha."""
    n = "sqrt(rot_0 * rot_0 + rot_1 * rot_1 + rot_2 * rot_2 + rot_3 * rot_3)"
    q = ", ".join(f"CASE WHEN {n} > 0 THEN rot_{i} / {n} ELSE {1.0 if i == 0 else 0.0} END AS u{i}" for i in range(4))
    m = {"00": "1 - 2 * (u2 * u2 + u3 * u3)", "01": "2 * (u1 * u2 - u0 * u3)", "02": "2 * (u1 * u3 + u0 * u2)", "10": "2 * (u1 * u2 + u0 * u3)", "11": "1 - 2 * (u1 * u1 + u3 * u3)", "12": "2 * (u2 * u3 - u0 * u1)", "20": "2 * (u1 * u3 - u0 * u2)", "21": "2 * (u2 * u3 + u0 * u1)", "22": "1 - 2 * (u1 * u1 + u2 * u2)"}
    return f"SELECT *, {', '.join(f'{v} AS m{k}' for k, v in m.items())}, {', '.join(f'exp(scale_{i}) AS e{i}' for i in range(3))}, 1 / (1 + exp(-opacity)) AS alpha FROM (SELECT *, {q} FROM ({rows}))"


def boxed(rows: str) -> str:
    half = [f"(abs(m{k}0) * e0 + abs(m{k}1) * e1 + abs(m{k}2) * e2) * 3" for k in range(3)]
    return "SELECT *, " + ", ".join(f"{c} {s} {half[k]} AS {n}_{c}" for n, s in (("lo", "-"), ("hi", "+")) for k, c in enumerate("xyz")) + f" FROM ({turned(rows)})"


def grid_cte(rows: str, size: float) -> str:
    """CTEs s (splats with boxes) and g (gx, gy, gz origin; n0, n1, n2)."""
    b = 4 * size
    return (
        f"s AS ({boxed(rows)}), g0 AS (SELECT " + ", ".join(f"floor(min(lo_{c}) / {b}) * {b} AS g{c}, ceil(max(hi_{c}) / {b}) * {b} AS h{c}" for c in "xyz")
        + " FROM s), g AS (SELECT gx, gy, gz, " + ", ".join(f"CAST(greatest(1, ceil((h{c} - g{c}) / {size})) AS INTEGER) AS n{k}" for k, c in enumerate("xyz")) + " FROM g0)"
    )


def hits_cte(rows: str, size: float, threshold: float) -> str:
    """CTEs up to hits (splat_id, cx, cy, cz, contribution), of all cells in the covered range; and rng with covered."""
    cell = lambda n, c: f"CAST(floor(({n}_{c} - g{c}) / {size}) AS BIGINT)"
    inside = lambda n: " AND ".join(f"{n}{k} >= 0 AND {n}{k} < n{k}" for k in range(3))
    d = [f"(g{c} + (c{c} + 0.5) * {size} - {c})" for c in "xyz"]
    local = [f"({' + '.join(f'm{k}{c} * {d[k]}' for k in range(3))}) / greatest(e{c}, 1e-6)" for c in range(3)]
    return (
        grid_cte(rows, size) + f", p0 AS (SELECT s.*, g.*, {', '.join(f'{cell(n, c)} AS {n}{k}' for n in ('lo', 'hi') for k, c in enumerate('xyz'))} FROM s, g WHERE alpha >= {threshold}), "
        + "p1 AS (SELECT * EXCLUDE (lo0, lo1, lo2, hi0, hi1, hi2), " + ", ".join(f"CASE WHEN {inside('lo')} THEN lo{k} ELSE 0 END AS lo{k}, CASE WHEN {inside('hi')} THEN hi{k} ELSE n{k} - 1 END AS hi{k}" for k in range(3)) + " FROM p0), "
        + "rng AS (SELECT *, (hi0 - lo0 + 1) * (hi1 - lo1 + 1) * (hi2 - lo2 + 1) AS covered FROM p1), p2 AS (SELECT *, unnest(generate_series(lo2, hi2)) AS cz FROM rng), p3 AS (SELECT *, unnest(generate_series(lo1, hi1)) AS cy FROM p2), p4 AS (SELECT *, unnest(generate_series(lo0, hi0)) AS cx FROM p3), "
        + f"hits AS (SELECT splat_id, CAST(cx AS INTEGER) AS cx, CAST(cy AS INTEGER) AS cy, CAST(cz AS INTEGER) AS cz, covered, alpha * exp(-0.5 * (({local[0]}) ** 2 + ({local[1]}) ** 2 + ({local[2]}) ** 2)) AS contribution FROM p4)"
    )


EMB = T.SPLATS_SQL
CELLS = "cells AS (SELECT DISTINCT cx, cy, cz FROM hits WHERE contribution >= {t})"


def emb_cells(spark: SparkSession, sf: str, size: float = SIZE, threshold: float = THRESHOLD):
    s = emb(spark, sf)
    g = voxel.grid_of(s, size)
    return s, g, voxel.solid_cells(s, g, threshold)


# Filters and transforms


@query(f"SELECT {', '.join(SCALARS)}, CAST(len(f_rest) AS INTEGER) AS n_rest, {q6('list_sum(f_rest)', 'rest_sum')} FROM ({EMB})")
def splat_decode_view(spark, sf):
    return emb(spark, sf).select(*SCALARS, F.size("f_rest").alias("n_rest"), six(F.aggregate("f_rest", F.lit(0.0), lambda a, v: a + v)).alias("rest_sum"))


@query(f"SELECT splat_id FROM ({EMB}) WHERE splat_id % 7 <> 0 AND splat_id % 11 <> 0")
def finite_filter(spark, sf):
    bad = emb(spark, sf).withColumns({"opacity": F.when(F.col("splat_id") % 7 == 0, float("nan")).otherwise(F.col("opacity")), "y": F.when(F.col("splat_id") % 11 == 0, float("inf")).otherwise(F.col("y"))})
    return filters.finite_filter(bad).select("splat_id")


@query(f"SELECT splat_id FROM ({EMB}) WHERE 1 / (1 + exp(-opacity)) >= 0.45")
def opacity_filter(spark, sf):
    return filters.opacity_filter(emb(spark, sf), 0.45).select("splat_id")


@query(f"SELECT splat_id FROM ({EMB}) WHERE x BETWEEN -1 AND 1 AND y BETWEEN -2 AND 0.5 AND z BETWEEN -1.5 AND 2")
def box_filter(spark, sf):
    return filters.box_filter(emb(spark, sf), (-1.0, -2.0, -1.5), (1.0, 0.5, 2.0)).select("splat_id")


@query(f"SELECT splat_id FROM ({EMB}) WHERE (x - 0.5) * (x - 0.5) + (y + 0.25) * (y + 0.25) + z * z <= 2.25")
def sphere_filter(spark, sf):
    return filters.sphere_filter(emb(spark, sf), (0.5, -0.25, 0.0), 1.5).select("splat_id")


@query(f"SELECT splat_id FROM ({EMB}) WHERE 1 / (1 + exp(-opacity)) >= 0.3 AND x BETWEEN -2 AND 2 AND y BETWEEN -2 AND 2 AND z BETWEEN -2 AND 2 AND x * x + y * y + z * z <= 4")
def recipe_chain_filter(spark, sf):
    s = filters.opacity_filter(filters.finite_filter(emb(spark, sf)), 0.3)
    return filters.sphere_filter(filters.box_filter(s, (-2.0,) * 3, (2.0,) * 3), (0.0,) * 3, 2.0).select("splat_id")


@query(f"SELECT count(*) AS n, round(avg(a), 6) AS mean, round(min(a), 6) AS least, round(max(a), 6) AS most FROM (SELECT 1 / (1 + exp(-opacity)) AS a FROM ({EMB}))")
def linear_alpha_stats(spark, sf):
    a = emb(spark, sf).select(X.alpha().alias("a"))
    return a.agg(F.count("*").alias("n"), F.round(F.avg("a"), 6).alias("mean"), F.round(F.min("a"), 6).alias("least"), F.round(F.max("a"), 6).alias("most"))


@query(f"SELECT splat_id, {q6('x * 0.5', 'x')}, {q6('y * 0.5', 'y')}, {q6('z * 0.5', 'z')}, {q6('scale_0 + ln(0.5)', 'scale_0')} FROM ({EMB})")
def align_scale(spark, sf):
    a = filters.Alignment.of(scale_points=((0, 0, 0), (4, 0, 0)), scale_distance=2.0)
    return filters.align(emb(spark, sf), a).select("splat_id", *[six(c).alias(c) for c in ("x", "y", "z", "scale_0")])


@query(f"SELECT splat_id, {q6('x', 'x')}, {q6('-z', 'y')}, {q6('y', 'z')} FROM ({EMB})")
def align_rotate_up_axis(spark, sf):
    return filters.align(emb(spark, sf), filters.Alignment.of("z", (0.0, 1.0, 0.0))).select("splat_id", *[six(c).alias(c) for c in "xyz"])


@query(f"SELECT splat_id, {q6('x - 2', 'x')}, {q6('y - 1', 'y')}, {q6('z - 3', 'z')} FROM ({EMB})")
def align_origin(spark, sf):
    return filters.align(emb(spark, sf), filters.Alignment.of(origin=(2.0, 1.0, 3.0))).select("splat_id", *[six(c).alias(c) for c in "xyz"])


@query("SELECT -1.0::DOUBLE AS min_x, -6.0::DOUBLE AS min_y, -2.0::DOUBLE AS min_z, 1.0::DOUBLE AS max_x, -1.0::DOUBLE AS max_y, 4.0::DOUBLE AS max_z FROM region LIMIT 1")
def aligned_box_corners(spark, sf):
    a = filters.Alignment.of("z", (0.0, 1.0, 0.0), origin=(0.0, 0.0, 0.0))
    low, high = a.box((-1.0, -2.0, 1.0), (1.0, 4.0, 6.0))
    return spark.createDataFrame([tuple(round(v, 6) + 0.0 for v in (*low, *high))], "min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")


@query(f"SELECT splat_id, {q6('-y', 'x')}, {q6('x + 2', 'y')}, {q6('z', 'z')} FROM ({EMB})")
def euler_transform(spark, sf):
    return filters.transform_scene(emb(spark, sf), filters.SceneTransform((0.0, 0.0, 90.0), (0.0, 2.0, 0.0))).select("splat_id", *[six(c).alias(c) for c in "xyz"])


@query("SELECT " + ", ".join(f"{f}({c}) AS {f}_{c}" for f in ("min", "max") for c in "xyz") + f" FROM ({EMB})")
def center_bounds(spark, sf):
    return filters.center_bounds(emb(spark, sf))


@query("SELECT splat_id, " + ", ".join(q6(f"{n}_{c}", f"{n}_{c}") for n in ("lo", "hi") for c in "xyz") + f" FROM ({boxed(EMB)})")
def gaussian_bounds(spark, sf):
    return filters.gaussian_bounds(emb(spark, sf)).select("splat_id", *[six(f"{n}_{c}").alias(f"{n}_{c}") for n in ("lo", "hi") for c in "xyz"])


@query("SELECT " + ", ".join(q6(f"{f}({n}_{c})", f"{f}_{c}") for f, n in (("min", "lo"), ("max", "hi")) for c in "xyz") + f" FROM ({boxed(EMB)})")
def scene_bounds(spark, sf):
    return filters.scene_bounds(emb(spark, sf)).select(*[six(f"{f}_{c}").alias(f"{f}_{c}") for f in ("min", "max") for c in "xyz"])


# Voxels


@query(f"WITH {grid_cte(EMB, SIZE)} SELECT gx AS min_x, gy AS min_y, gz AS min_z, n0 AS nx, n1 AS ny, n2 AS nz FROM g")
def grid_header(spark, sf):
    g = voxel.grid_of(emb(spark, sf), SIZE)
    return spark.createDataFrame([(*g.origin, *g.dims)], "min_x double, min_y double, min_z double, nx int, ny int, nz int")


@query(f"WITH {hits_cte(EMB, SIZE, THRESHOLD)} SELECT splat_id, count(*) AS n, {q6('max(contribution)', 'best')} FROM hits WHERE contribution >= {THRESHOLD} GROUP BY splat_id")
def contribution_at_centers(spark, sf):
    s = emb(spark, sf)
    c = voxel.contributions(s, voxel.grid_of(s, SIZE), THRESHOLD).where(F.col("contribution") >= THRESHOLD)
    return c.groupBy("splat_id").agg(F.count("*").alias("n"), six(F.max("contribution")).alias("best"))


@query(f"WITH {hits_cte(EMB, SIZE, THRESHOLD)}, {CELLS.format(t=THRESHOLD)} SELECT * FROM cells")
def voxel_solid_cells(spark, sf):
    return emb_cells(spark, sf)[2]


@query(f"WITH {hits_cte(T.LINE_SPLATS_SQL, 0.125, 0.1)}, {CELLS.format(t=0.1)} SELECT count(*) AS n, sum(cx) AS sx, sum(cy) AS sy, sum(cz) AS sz FROM cells")
def voxel_solid_count(spark, sf):
    s = T.splats_from_lineitem(spark, sf)
    return voxel.solid_cells(s, voxel.grid_of(s, 0.125), 0.1).agg(F.count("*").alias("n"), *[F.sum(f"c{c}").cast("decimal(38,0)").alias(f"s{c}") for c in "xyz"])


@query(f"WITH {hits_cte(EMB, SIZE, THRESHOLD)} SELECT splat_id, covered FROM rng")
def voxel_candidates_per_splat(spark, sf):
    s = emb(spark, sf)
    g = voxel.grid_of(s, SIZE)
    p = voxel._prepared(s, g, THRESHOLD, ["splat_id"])
    return p.select("splat_id", ((F.col("hi0") - F.col("lo0") + 1) * (F.col("hi1") - F.col("lo1") + 1) * (F.col("hi2") - F.col("lo2") + 1)).alias("covered"))


@query(f"WITH {hits_cte(EMB, SIZE, THRESHOLD)} SELECT count(*) AS ties FROM hits WHERE abs(contribution - {THRESHOLD}) < 1e-6")
def voxel_threshold_ties(spark, sf):
    s = emb(spark, sf)
    c = voxel.contributions(s, voxel.grid_of(s, SIZE), THRESHOLD - 1e-5)
    return c.where(F.abs(F.col("contribution") - THRESHOLD) < 1e-6).agg(F.count("*").alias("ties"))


@query(f"WITH {hits_cte(EMB, SIZE, THRESHOLD)} SELECT count(*) AS mismatches FROM (SELECT cx, cy, cz FROM hits GROUP BY ALL HAVING max(contribution) >= 0.1 AND max(contribution) < 0.3)")
def mismatch_count(spark, sf):
    s, g, cells = emb_cells(spark, sf)
    return voxel.mismatch_count(cells, voxel.solid_cells(s, g, 0.3))


ISL = f"c AS ({T.ISLAND_SQL})"
NEAR = "d(dx, dy, dz) AS (VALUES (-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1))"
#: Events in a layer of the sparse lattice, in which a capsule has room.
FEW = 12


def lattice(spark: SparkSession, sf: str, per: int = 60) -> voxel.Grid:
    return voxel.Grid((0.0, 0.0, 0.0), 1.0, (T.island_layers(spark, sf, per), 16, 20))


GRID_SQL = "grid AS (SELECT CAST(x AS INTEGER) AS cx, CAST(y AS INTEGER) AS cy, CAST(z AS INTEGER) AS cz FROM range((SELECT max(event_id) // {per} + 1 FROM events)) a(x), range(16) b(y), range(20) e(z))"


@query(f"WITH {ISL}, {NEAR} SELECT c.cx, c.cy, c.cz, count(o.cx) AS degree FROM c, d LEFT JOIN c o ON o.cx = c.cx + dx AND o.cy = c.cy + dy AND o.cz = c.cz + dz GROUP BY ALL")
def neighbors6_degree(spark, sf):
    c = T.island_cells(spark, sf)
    near = voxel.neighbours(c).join(c.select(F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("cz").alias("nz"), F.lit(1).alias("one")), ["nx", "ny", "nz"], "left")
    return near.groupBy("cx", "cy", "cz").agg(F.count("one").alias("degree"))


@query(f"WITH {hits_cte(EMB, SIZE, 0.3)}, {CELLS.format(t=0.3)} SELECT cx - (SELECT min(cx) FROM cells) AS cx, cy - (SELECT min(cy) FROM cells) AS cy, cz - (SELECT min(cz) FROM cells) AS cz FROM cells")
def crop_to_occupied(spark, sf):
    _, g, cells = emb_cells(spark, sf, SIZE, 0.3)
    return morph.crop(cells, g)[0]


@query(f"WITH {ISL}, m AS (SELECT cx, cz, min(cy) AS low FROM c GROUP BY ALL) SELECT * FROM c UNION SELECT cx, CAST(unnest(range(low)) AS INTEGER) AS cy, cz FROM m WHERE low > 0")
def floor_fill(spark, sf):
    return morph.floor_fill(T.island_cells(spark, sf))


DILATED = "dil AS (SELECT DISTINCT g.* FROM grid g, c WHERE abs(g.cx - c.cx) <= 1 AND abs(g.cy - c.cy) <= 1 AND abs(g.cz - c.cz) <= 1)"
SPARSE = f"c AS ({T.island_sql(FEW)}), {GRID_SQL.format(per=FEW)}"


def sparse(spark: SparkSession, sf: str) -> DataFrame:
    return T.island_cells(spark, sf, FEW)


def _all_cells(spark: SparkSession, layers: int) -> DataFrame:
    at = F.col("id")
    return spark.range(layers * 16 * 20).select((at % layers).cast("int").alias("cx"), (F.floor(at / layers) % 16).cast("int").alias("cy"), F.floor(at / (16 * layers)).cast("int").alias("cz"))


def walls(spark: SparkSession, sf: str) -> DataFrame:
    """A closed room in the lattice, and the sparse cells."""
    room = _all_cells(spark, 24)
    shell = "cx BETWEEN 4 AND 19 AND cy BETWEEN 2 AND 13 AND cz BETWEEN 3 AND 16 AND (cx IN (4, 19) OR cy IN (2, 13) OR cz IN (3, 16))"
    return room.where(shell).union(sparse(spark, sf)).distinct()


WALLS = f"c0 AS ({T.island_sql(FEW)}), {GRID_SQL.format(per=FEW)}, c AS (SELECT * FROM grid WHERE cx BETWEEN 4 AND 19 AND cy BETWEEN 2 AND 13 AND cz BETWEEN 3 AND 16 AND (cx IN (4, 19) OR cy IN (2, 13) OR cz IN (3, 16)) UNION SELECT * FROM c0)"
FACE = f"(cx = 0 OR cx = (SELECT max(event_id) // {FEW} FROM events) OR cy IN (0, 15) OR cz IN (0, 19))"
FLOOD = f"{NEAR}, free AS (SELECT * FROM grid EXCEPT SELECT * FROM {{solid}}), fl AS (SELECT * FROM free WHERE {{start}} UNION SELECT f.cx, f.cy, f.cz FROM fl, d, free f WHERE f.cx = fl.cx + dx AND f.cy = fl.cy + dy AND f.cz = fl.cz + dz)"


@query(f"WITH {SPARSE}, {DILATED} SELECT * FROM dil")
def dilate_cells(spark, sf):
    return morph.dilate(sparse(spark, sf), lattice(spark, sf, FEW), 1)


@query(f"WITH RECURSIVE {WALLS}, {FLOOD.format(solid='c', start=FACE)} SELECT * FROM fl")
def exterior_outside(spark, sf):
    return voxel.expand_runs(morph.outside_runs(walls(spark, sf), lattice(spark, sf, FEW)))


@query(f"WITH RECURSIVE {WALLS}, {FLOOD.format(solid='c', start=FACE)} SELECT * FROM fl UNION SELECT * FROM c")
def exterior_fill(spark, sf):
    return morph.exterior_fill(walls(spark, sf), lattice(spark, sf, FEW), 0.0, (6.5, 4.5, 5.5)).cells


# A capsule of radius 1 and half height 1; the low sides are blocked.
BLOCKED = "bl AS (SELECT * FROM grid g WHERE cx < 1 OR cy < 1 OR cz < 1 OR EXISTS (SELECT 1 FROM c WHERE (g.cx - c.cx) * (g.cx - c.cx) + (g.cz - c.cz) * (g.cz - c.cz) <= 1 AND abs(g.cy - c.cy) <= 1))"


@query(f"WITH {WALLS}, {BLOCKED} SELECT * FROM bl")
def capsule_blocked(spark, sf):
    inside = morph.capsule_solid(walls(spark, sf), lattice(spark, sf, FEW), 1, 1)
    edge = "cx < 1 OR cy < 1 OR cz < 1"
    return inside.where(f"NOT ({edge})").union(_all_cells(spark, T.island_layers(spark, sf, FEW)).where(edge))


@query(f"WITH {WALLS}, {BLOCKED}, free AS (SELECT * FROM grid EXCEPT SELECT * FROM bl) SELECT cx, cy, cz FROM free WHERE (cx, cy, cz) <> (4, 6, 8) AND greatest(abs(cx - 4), abs(cy - 6), abs(cz - 8)) <= 4 ORDER BY greatest(abs(cx - 4), abs(cy - 6), abs(cz - 8)), cz - 8, cy - 6, cx - 4 LIMIT 1")
def nearest_unblocked(spark, sf):
    found = morph.nearest_free(morph.capsule_solid(walls(spark, sf), lattice(spark, sf, FEW), 1, 1), lattice(spark, sf, FEW), (4, 6, 8), 1, 1)
    return spark.createDataFrame([found] if found else [], "cx int, cy int, cz int")


REACH = f"{WALLS}, {BLOCKED}, {{flood}}".replace("{flood}", FLOOD.format(solid="bl", start="(cx, cy, cz) = (SELECT (s.cx, s.cy, s.cz) FROM (SELECT * FROM (SELECT * FROM grid EXCEPT SELECT * FROM bl) WHERE cx BETWEEN 6 AND 16 AND cy BETWEEN 4 AND 11 AND cz BETWEEN 5 AND 14 ORDER BY cz, cy, cx LIMIT 1) s)"))


def _seed(cells: DataFrame, grid: voxel.Grid, radius: int = 1) -> tuple:
    blocked = morph.capsule_solid(cells, grid, radius, 1)
    free = voxel.expand_runs(morph.empty_runs(blocked, grid, (radius, 1, radius))).where("cx BETWEEN 6 AND 16 AND cy BETWEEN 4 AND 11 AND cz BETWEEN 5 AND 14")
    r = free.orderBy("cz", "cy", "cx").head()
    return (r["cx"] + 0.5, r["cy"] + 0.5, r["cz"] + 0.5)


@query(f"WITH RECURSIVE {REACH} SELECT * FROM fl")
def carve_reachable(spark, sf):
    cells, grid = walls(spark, sf), lattice(spark, sf, FEW)
    return voxel.expand_runs(morph.carve(cells, grid, 2.0, 1.0, _seed(cells, grid)).reachable)


# A thin agent: of radius 0 it can stand beside what is solid, so that its room has a border.
THIN = "bl AS (SELECT * FROM grid g WHERE cy < 1 OR EXISTS (SELECT 1 FROM c WHERE g.cx = c.cx AND g.cz = c.cz AND abs(g.cy - c.cy) <= 1))"
THIN_REACH = f"{WALLS}, {THIN}, {{flood}}".replace("{flood}", FLOOD.format(solid="bl", start="(cx, cy, cz) = (SELECT (s.cx, s.cy, s.cz) FROM (SELECT * FROM (SELECT * FROM grid EXCEPT SELECT * FROM bl) WHERE cx BETWEEN 6 AND 16 AND cy BETWEEN 4 AND 11 AND cz BETWEEN 5 AND 14 ORDER BY cz, cy, cx LIMIT 1) s)"))


@query(f"WITH RECURSIVE {THIN_REACH} SELECT DISTINCT c.cx, c.cy, c.cz FROM c, d, fl WHERE fl.cx = c.cx + dx AND fl.cy = c.cy + dy AND fl.cz = c.cz + dz")
def carve_border(spark, sf):
    cells, grid = walls(spark, sf), lattice(spark, sf, FEW)
    return morph.carve(cells, grid, 2.0, 0.0, _seed(cells, grid, 0)).cells


@query(f"WITH {ISL} SELECT cx, cy, cz FROM c ORDER BY (cx - 11) * (cx - 11) + (cy - 7) * (cy - 7) + (cz - 9) * (cz - 9), cz, cy, cx LIMIT 1")
def cluster_seed_resolve(spark, sf):
    return spark.createDataFrame([voxel.nearest_solid(T.island_cells(spark, sf), (11, 7, 9))], "cx int, cy int, cz int")


GROW = f"{NEAR}, sd AS (SELECT cx, cy, cz FROM cells ORDER BY (cx - {{x}}) * (cx - {{x}}) + (cy - {{y}}) * (cy - {{y}}) + (cz - {{z}}) * (cz - {{z}}), cz, cy, cx LIMIT 1), fl AS (SELECT * FROM sd UNION SELECT f.cx, f.cy, f.cz FROM fl, d, cells f WHERE f.cx = fl.cx + dx AND f.cy = fl.cy + dy AND f.cz = fl.cz + dz)"


@query(f"WITH RECURSIVE cells AS ({T.ISLAND_SQL}), {GROW.format(x=11, y=7, z=9)} SELECT * FROM fl")
def cluster_component(spark, sf):
    c = T.island_cells(spark, sf)
    return voxel.component_of(c, lattice(spark, sf), voxel.nearest_solid(c, (11, 7, 9)))


CLUSTER = f"WITH RECURSIVE {hits_cte(EMB, 0.5, 0.3)}, {CELLS.format(t=0.3)}, sd0 AS (SELECT CAST(floor((0 - gx) / 0.5) AS INTEGER) AS ax, CAST(floor((0 - gy) / 0.5) AS INTEGER) AS ay, CAST(floor((0 - gz) / 0.5) AS INTEGER) AS az FROM g), {GROW.format(x='(SELECT ax FROM sd0)', y='(SELECT ay FROM sd0)', z='(SELECT az FROM sd0)')}"


@query(CLUSTER + f", k AS (SELECT splat_id FROM hits JOIN fl USING (cx, cy, cz) WHERE contribution >= 0.3 GROUP BY splat_id, covered HAVING count(*) >= CASE WHEN covered > 64 THEN greatest(covered // 16, 2) ELSE 1 END) SELECT splat_id FROM k UNION SELECT splat_id FROM s, g, fl WHERE alpha >= 0.3 AND cx = floor((x - gx) / 0.5) AND cy = floor((y - gy) / 0.5) AND cz = floor((z - gz) / 0.5)")
def cluster_filter(spark, sf):
    return voxel.cluster_filter(emb(spark, sf), 0.5, 0.3, (0.0, 0.0, 0.0), 0.3).splats.select("splat_id")


@query(f"WITH {hits_cte(EMB, SIZE, THRESHOLD)}, {CELLS.format(t=THRESHOLD)} SELECT DISTINCT splat_id FROM hits JOIN cells USING (cx, cy, cz) WHERE contribution >= 0.4")
def floater_filter(spark, sf):
    s, g, cells = emb_cells(spark, sf)
    return voxel.floater_filter(s, cells, g, THRESHOLD, 0.4).select("splat_id")


# Meshes


EXPOSED = f"WITH {ISL}, d(side, dx, dy, dz) AS (VALUES (0, -1, 0, 0), (1, 1, 0, 0), (2, 0, -1, 0), (3, 0, 1, 0), (4, 0, 0, -1), (5, 0, 0, 1)), f AS (SELECT c.cx, c.cy, c.cz, side FROM c, d WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.cx = c.cx + dx AND o.cy = c.cy + dy AND o.cz = c.cz + dz))"


@query(EXPOSED + " SELECT * FROM f")
def exposed_faces(spark, sf):
    return mesh.exposed_faces(T.island_cells(spark, sf))


@query(EXPOSED + " SELECT 2 * count(*) AS triangles, CAST(count(*) AS DOUBLE) AS area FROM f")
def face_triangle_count(spark, sf):
    m = mesh.with_area(mesh.face_mesh(T.island_cells(spark, sf), lattice(spark, sf)))
    return m.agg(F.count("*").alias("triangles"), F.round(F.sum("area"), 6).alias("area"))


CASES = f"WITH {ISL}, k AS (SELECT cx - x AS ux, cy - y AS uy, cz - z AS uz, 1 << CAST(x + 2 * y + 4 * z AS INTEGER) AS bit FROM c, range(2) a(x), range(2) b(y), range(2) e(z)), cs AS (SELECT CAST(ux AS INTEGER) AS ux, CAST(uy AS INTEGER) AS uy, CAST(uz AS INTEGER) AS uz, CAST(sum(bit) AS INTEGER) AS \"case\" FROM k GROUP BY ALL HAVING sum(bit) <> 255)"


@query(CASES + " SELECT * FROM cs")
def mc_case_index(spark, sf):
    return mesh.cube_indices(T.island_cells(spark, sf))


# Triangles of a cube by its corners alone: crossed edges less two for each closed line, and these part the cube's surface into the pieces
# of solid corners (next to each other) and of free ones (also across a face), one piece more than lines.
COUNTS = (
    'v AS (SELECT CAST(k AS INTEGER) AS "case", CAST(i AS INTEGER) AS i, (k >> i) & 1 AS s FROM range(256) a(k), range(8) b(i)), w AS (SELECT v.*, o.i AS j, o.s AS t, bit_count(xor(v.i, o.i)) AS far FROM v JOIN v o USING ("case")), '
    'r AS (SELECT "case", s, i, i AS j FROM v UNION SELECT r."case", r.s, r.i, w.j FROM r JOIN w ON w."case" = r."case" AND w.i = r.j AND w.t = r.s AND w.far <= 2 - r.s), m AS (SELECT "case", s, i, min(j) AS piece FROM r GROUP BY ALL), '
    'pc AS (SELECT "case", count(DISTINCT (s, piece)) AS pieces FROM m GROUP BY ALL), n AS (SELECT "case", (SELECT count(*) FROM w WHERE w."case" = pc."case" AND far = 1 AND s < t) - 2 * (pieces - 1) AS n FROM pc)'
)


@query(CASES.replace("WITH", "WITH RECURSIVE", 1) + f', {COUNTS} SELECT CAST(sum(n) AS BIGINT) AS triangles FROM cs JOIN n USING ("case")')
def mc_triangles(spark, sf):
    return mesh.smooth_mesh(T.island_cells(spark, sf), lattice(spark, sf)).agg(F.count("*").alias("triangles"))


@query(EXPOSED + ", v AS (SELECT DISTINCT cx + CASE side WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE u END AS x, cy + CASE side WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 0 THEN u WHEN 1 THEN u ELSE w END AS y, cz + CASE side WHEN 4 THEN 0 WHEN 5 THEN 1 WHEN 2 THEN u WHEN 3 THEN u ELSE w END AS z FROM (SELECT f.*, a.u, b.w FROM f, range(2) a(u), range(2) b(w)) WHERE side IN (0, 1) OR side IN (4, 5)), h AS (SELECT DISTINCT cx + a AS x, cy + side - 2 AS y, cz + b AS z FROM f, range(2) p(a), range(2) q(b) WHERE side IN (2, 3)) SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM v UNION SELECT CAST(x AS DOUBLE), CAST(y AS DOUBLE), CAST(z AS DOUBLE) FROM h")
def weld_vertices(spark, sf):
    return mesh.weld(mesh.face_mesh(T.island_cells(spark, sf), lattice(spark, sf)))[0].select("x", "y", "z")


def shown(coord: str) -> Column:
    """Millionths as the int of the SQL, which has no result beyond it; planes further out stay apart and show its ends."""
    return F.greatest(F.lit(-(1 << 31)), F.least(F.lit((1 << 31) - 1), F.col(coord))).cast("int")


@query(EXPOSED + " SELECT CAST(side // 2 AS INTEGER) AS axis, CAST(CASE WHEN side IN (1, 2, 4) THEN -1 ELSE 1 END AS INTEGER) AS sign, CAST(1000000 * (CASE side // 2 WHEN 0 THEN cx WHEN 1 THEN cy ELSE cz END + side % 2) AS INTEGER) AS coord, 2 * count(*) AS triangles FROM f GROUP BY ALL")
def coplanar_groups(spark, sf):
    groups = mesh.planes(mesh.face_mesh(T.island_cells(spark, sf), lattice(spark, sf))).groupBy("axis", "sign", "coord").agg(F.count("*").alias("triangles"))
    return groups.withColumn("coord", shown("coord"))


@query(EXPOSED + " SELECT CAST(count(*) AS DOUBLE) AS area FROM f")
def coplanar_merge(spark, sf):
    m = mesh.with_area(mesh.merge_rectangles(mesh.face_mesh(T.island_cells(spark, sf), lattice(spark, sf)), mesh.TILE_SIDES))
    return m.agg(F.round(F.sum("area"), 6).alias("area"))


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of a box for each supplier, apart from each other."""
    p = spark.read.parquet(f"{sf}/supplier.parquet").select((F.col("s_suppkey") * 8).cast("int").alias("at"), (F.col("s_suppkey") % 5).cast("int").alias("a"), (F.col("s_nationkey") % 4).cast("int").alias("b"), (F.col("s_suppkey") % 3).cast("int").alias("c"))
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n)))
    return p.withColumn("i", span("a")).withColumn("cy", span("b")).withColumn("cz", span("c")).select((F.col("at") + F.col("i")).alias("cx"), "cy", "cz")


BOXES = "b AS (SELECT s_suppkey * 8 AS x0, s_suppkey * 8 + 1 + s_suppkey % 5 AS x1, 1 + s_nationkey % 4 AS y1, 1 + s_suppkey % 3 AS z1 FROM supplier)"
BOX_SIDES = "s AS (SELECT 0 AS axis, 1 AS sign, x0 AS coord, y1 * z1 AS area FROM b UNION ALL SELECT 0, -1, x1, y1 * z1 FROM b UNION ALL SELECT 1, -1, 0, (x1 - x0) * z1 FROM b UNION ALL SELECT 1, 1, y1, (x1 - x0) * z1 FROM b UNION ALL SELECT 2, -1, 0, (x1 - x0) * y1 FROM b UNION ALL SELECT 2, 1, z1, (x1 - x0) * y1 FROM b)"


@query(f"WITH {BOXES}, {BOX_SIDES} SELECT axis, sign, CAST(coord * 1000000 AS INTEGER) AS coord, 2 * count(*) AS triangles, CAST(sum(area) AS DOUBLE) AS area FROM s GROUP BY ALL")
def coplanar_rectangles(spark, sf):
    """Each side of a box is two triangles once merged, however many faces it had."""
    m = mesh.merge_rectangles(mesh.face_mesh(boxes(spark, sf), voxel.Grid((0.0, 0.0, 0.0), 1.0, (1 << 31, 4, 3))))
    return mesh.planes(m).groupBy("axis", "sign", "coord").agg(F.count("*").alias("triangles"), F.round(F.sum("area"), 6).alias("area")).withColumn("coord", shown("coord"))


@query()
def point_triangle_error(spark, sf):
    s, g, cells = emb_cells(spark, sf, 0.5, 0.3)
    return evaluate.point_errors(evaluate.stride_sample(s, 256), mesh.face_mesh(cells, g)).select("splat_id", six("distance").alias("distance"))


RANKED = f"d AS (SELECT sqrt(x * x + y * y + z * z) AS d, row_number() OVER (ORDER BY sqrt(x * x + y * y + z * z)) AS r, count(*) OVER () AS m FROM ({EMB}))"


@query(f"WITH {RANKED} SELECT CAST(count(*) AS INTEGER) AS sample_count, round(avg(d), 6) AS mean, round(sqrt(avg(d * d)), 6) AS rms, round(max(d) FILTER (r = round((m - 1) * 0.95) + 1), 6) AS p95 FROM d")
def error_summary_p95(spark, sf):
    d = emb(spark, sf).select(F.sqrt(X.d("x") * X.d("x") + X.d("y") * X.d("y") + X.d("z") * X.d("z")).alias("distance"))
    return evaluate.error_summary(d).select("sample_count", *[F.round(c, 6).alias(c) for c in ("mean", "rms", "p95")])


@query(f"WITH r AS (SELECT splat_id, x, y, z, (5 - y) AS t, x * x + z * z AS d2 FROM ({EMB}) WHERE 5 - y >= 0) SELECT splat_id, x, y, z FROM r ORDER BY CASE WHEN d2 <= 0.0625 THEN 0 ELSE 1 END, CASE WHEN d2 <= 0.0625 THEN t ELSE d2 END, splat_id LIMIT 1")
def pick_ray(spark, sf):
    return evaluate.pick(emb(spark, sf), (0.0, 5.0, 0.0), (0.0, -1.0, 0.0), 0.25)


# SOG


def _code(v: str, low: str, high: str, most: int) -> str:
    return f"CAST(round(greatest(0, least(1, ({v} - {low}) / ({high} - {low}))) * {most}) AS INTEGER)"


@query(f"WITH l AS (SELECT splat_id, {', '.join(f'sign({c}) * ln(abs({c}) + 1) AS l{c}' for c in 'xyz')} FROM ({EMB})) SELECT splat_id, " + ", ".join(_code(f"l{c}", f"(SELECT min(l{c}) FROM l)", f"(SELECT max(l{c}) FROM l)", 65535) + f" AS m{c}" for c in "xyz") + " FROM l")
def sog_means_quantize(spark, sf):
    return sog.means(emb(spark, sf))[0]


@query(f"WITH e AS ({EMB}), r AS (SELECT least(min(scale_0), min(scale_1), min(scale_2)) AS lo, greatest(max(scale_0), max(scale_1), max(scale_2)) AS hi FROM e) SELECT splat_id, " + ", ".join(_code(f"scale_{i}", "lo", "hi", 255) + f" AS c_scale_{i}" for i in range(3)) + " FROM e, r")
def sog_scale_codebook(spark, sf):
    return sog.codebook_codes(emb(spark, sf), [f"scale_{i}" for i in range(3)])[0]


_B = lambda v: f"CAST(round((greatest(-1, least(1, {v} * sg * sqrt(2.0))) + 1) / 2 * 255) AS INTEGER)"
_R = lambda k: f"CASE WHEN lg <= {k} THEN u{k + 1} ELSE u{k} END"


@query(f"WITH t AS ({turned(EMB)}), l AS (SELECT *, CAST(CASE WHEN abs(u3) = mx THEN 3 WHEN abs(u2) = mx THEN 2 WHEN abs(u1) = mx THEN 1 ELSE 0 END AS INTEGER) AS lg FROM (SELECT *, greatest(abs(u0), abs(u1), abs(u2), abs(u3)) AS mx FROM t)), w AS (SELECT *, CASE WHEN CASE lg WHEN 0 THEN u0 WHEN 1 THEN u1 WHEN 2 THEN u2 ELSE u3 END < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sg FROM l) SELECT splat_id, {_B(_R(0))} AS q0, {_B(_R(1))} AS q1, {_B(_R(2))} AS q2, lg + 252 AS tag FROM w")
def sog_quat_pack(spark, sf):
    return sog.quat_pack(emb(spark, sf))


@query(f"SELECT CAST(splat_id % 64 AS BIGINT) AS label, CAST(k AS INTEGER) AS coeff, {q6('avg(f_rest[k + 1])', 'centroid')} FROM ({EMB}), range(45) r(k) GROUP BY ALL")
def sog_sh_palette(spark, sf):
    p = sog.sh_palette(emb(spark, sf), "splat_id", 64)
    return p.select("label", "coeff", six("centroid").alias("centroid"))


@query()
def sog_roundtrip_error(spark, sf):
    codes, r = sog.means(emb(spark, sf))
    back = {c: sog.signed_exp(F.col(f"m{c}") / 65535 * (r[c][1] - r[c][0]) + r[c][0]) for c in "xyz"}
    both = codes.join(emb(spark, sf), "splat_id")
    return both.agg(F.count_if(F.greatest(*[F.abs(v - F.col(c)) for c, v in back.items()]) > 0.001).alias("over"))


# Files, written to the shared folder and read again


def _again(spark: SparkSession, splats: DataFrame, kind: str) -> DataFrame:
    """The scene as it is read from a file of the format, which is put into the shared folder and deleted with the application."""
    import tempfile

    from splatlake.functions.storage import put, shared_dir
    from splatlake.sinks import files
    from splatlake.sources.readers import read_source

    with tempfile.TemporaryDirectory() as own:
        name = f"scene-{uuid.uuid4().hex}.{kind}"
        {"splat": files.write_splat, "ply": files.write_ply, "sog": files.write_sog}[kind](splats, f"{own}/{name}")
        path = put(spark, f"{own}/{name}", f"{shared_dir(spark)}/{name}")
    return read_source(spark, path)[0]


_NTH = "row_number() OVER (ORDER BY splat_id) - 1 AS splat_id"
_BYTE = lambda v: f"CAST(round(greatest(0, least(1, {v})) * 255) AS INTEGER)"


@query(f"SELECT {_NTH}, x, y, z, {', '.join(q6(f'scale_{i}', f'scale_{i}').replace(', 6)', ', 5)') for i in range(3))}, {_BYTE('1 / (1 + exp(-opacity))')} AS alpha, {', '.join(_BYTE(f'f_dc_{i} * 0.2820948 + 0.5') + f' AS c{i}' for i in range(3))} FROM ({EMB})")
def splat_file_roundtrip(spark, sf):
    byte = lambda v: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255).cast("int")
    t = _again(spark, emb(spark, sf), "splat")
    return t.select("splat_id", "x", "y", "z", *[(F.round(f"scale_{i}", 5) + 0.0).alias(f"scale_{i}") for i in range(3)], byte(1 / (1 + F.exp(-F.col("opacity")))).alias("alpha"), *[byte(F.col(f"f_dc_{i}") * 0.2820948 + 0.5).alias(f"c{i}") for i in range(3)])


@query(f"SELECT {_NTH}, x, y, z, scale_0, scale_1, scale_2, opacity, f_dc_0, f_dc_1, f_dc_2 FROM ({EMB})")
def ply_file_roundtrip(spark, sf):
    return _again(spark, emb(spark, sf), "ply").select("splat_id", "x", "y", "z", "scale_0", "scale_1", "scale_2", "opacity", "f_dc_0", "f_dc_1", "f_dc_2")


@query(f"SELECT {_NTH}, true AS place, true AS scale, true AS alpha, true AS turn FROM ({EMB})")
def sog_file_roundtrip(spark, sf):
    """Within the tolerances of the format: 0.001, 0.01, 0.005, and a dot product of quaternions over 0.999."""
    from splatlake.operators.evaluate import dense_index

    source = dense_index(emb(spark, sf), "splat_id").select(F.col("row").alias("splat_id"), *[F.col(c).alias(f"s_{c}") for c in X.SCALARS], F.array(*X.unit_quaternion()).alias("s_q"))
    t = _again(spark, emb(spark, sf), "sog").join(source, "splat_id")
    near = lambda names, most: F.greatest(*[F.abs(X.d(c) - F.col(f"s_{c}")) for c in names]) <= most
    alpha = lambda c: 1 / (1 + F.exp(-F.col(c)))
    dot = sum((F.get("s_q", F.lit(i)) * v for i, v in enumerate(X.unit_quaternion())), F.lit(0.0))
    return t.select("splat_id", near("xyz", 0.001).alias("place"), near([f"scale_{i}" for i in range(3)], 0.01).alias("scale"), (F.abs(alpha("opacity") - alpha("s_opacity")) <= 0.005).alias("alpha"), (F.abs(dot) > 0.999).alias("turn"))


# Navigation, scenes, settings


def terrain(spark: SparkSession, sf: str) -> DataFrame:
    """Triangles over lineitem's lattice, some steep and some facing down."""
    from splatlake.operators.mesh import CORNERS

    p = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("tid"), (F.col("o_orderkey") % 40).cast("double").alias("x"), (F.col("o_custkey") % 40).cast("double").alias("z"), (F.col("o_orderkey") % 7 / 4).alias("h"), (F.col("o_custkey") % 3 == 0).alias("down"))
    v = [("x", 0, "z", 0.0), ("x", 0, "z", 1.0), ("x", 1, "z", 0.0)]
    place = lambda k, c: {"x": F.col("x") + v[k][1], "y": F.lit(0.0) if k < 2 else F.col("h"), "z": F.col("z") + v[k][3]}[c]
    order = [(0, 0), (1, 2), (2, 1)]
    cols = [F.when(F.col("down"), place(order[k][1], c)).otherwise(place(k, c)) for k in range(3) for c in "xyz"]
    return p.select("tid", *[c.cast("double").alias(n) for c, n in zip(cols, CORNERS, strict=True)])


@query("SELECT o_orderkey AS tid FROM orders WHERE o_custkey % 3 <> 0 AND o_orderkey % 7 / 4.0 < 1")
def navmesh_walkable_triangles(spark, sf):
    return navmesh.walkable_triangles(terrain(spark, sf), 45.0).select("tid")


# Each face that looks up or down makes a span of one height from its own up; what touches is merged, and the highest face says if one can walk.
FACES = "f AS (SELECT cx AS gx, cz AS gz, cy + 1 AS bottom, true AS up FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.cx = c.cx AND o.cz = c.cz AND o.cy = c.cy + 1) UNION ALL SELECT cx, cz, cy, false FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.cx = c.cx AND o.cz = c.cz AND o.cy = c.cy - 1))"
MERGED = "r AS (SELECT *, max(bottom + 1) OVER (PARTITION BY gx, gz ORDER BY bottom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f), m AS (SELECT *, sum(CASE WHEN bottom <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY gx, gz ORDER BY bottom ROWS UNBOUNDED PRECEDING) AS span FROM r)"


SPANS = f"{ISL}, {FACES}, {MERGED}, sp AS (SELECT CAST(gx AS INTEGER) AS gx, CAST(gz AS INTEGER) AS gz, CAST(min(bottom) AS INTEGER) AS bottom, CAST(max(bottom) + 1 AS INTEGER) AS top, arg_max(up, bottom) AS walkable FROM m GROUP BY gx, gz, span)"


@query(f"WITH {SPANS} SELECT * FROM sp")
def navmesh_spans(spark, sf):
    m = mesh.face_mesh(T.island_cells(spark, sf), lattice(spark, sf)).where("ay = by AND by = cy")
    low = {k: F.least(*[F.col(f"{v}{k}") for v in "abc"]) for k in "xz"}
    # A little smaller, so that a face lies in one cell.
    inner = X.computed(m, ["tid"], {c: low[c[1]] + 0.05 + 0.9 * (F.col(c) - low[c[1]]) if c[1] != "y" else F.col(c) for c in mesh.CORNERS})
    return navmesh.spans(inner, navmesh.NavmeshParams(cell_size=1.0, cell_height=1.0)).select("gx", "gz", "bottom", "top", "walkable")


LOW_HANGING = "lh AS (SELECT gx, gz, bottom, top, walkable OR coalesce(lag(walkable) OVER w AND top - lag(top) OVER w <= 2, false) AS walkable FROM sp WINDOW w AS (PARTITION BY gx, gz ORDER BY bottom))"


@query(f"WITH {SPANS}, {LOW_HANGING} SELECT * FROM lh")
def navmesh_low_hanging(spark, sf):
    return navmesh.low_hanging(navmesh_spans(spark, sf), 2).select("gx", "gz", "bottom", "top", "walkable")


@query(
    f"WITH {SPANS}, {LOW_HANGING}, rm AS (SELECT *, coalesce(lead(bottom) OVER (PARTITION BY gx, gz ORDER BY bottom) - top, 1000000) AS room FROM lh), "
    "st AS (SELECT gx, gz, top AS floor, top + room AS ceiling FROM rm UNION ALL SELECT gx, gz, -1000000, min(bottom) FROM rm GROUP BY gx, gz), d(dx, dz) AS (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)), "
    "nb AS (SELECT rm.gx, rm.gz, rm.top, st.floor - rm.top AS step, st.floor IS NULL AS none FROM rm CROSS JOIN d LEFT JOIN st ON st.gx = rm.gx + dx AND st.gz = rm.gz + dz AND least(rm.top + room, ceiling) - greatest(rm.top, floor) >= 2 WHERE walkable), "
    "gap AS (SELECT DISTINCT rm.gx, rm.gz FROM rm CROSS JOIN d WHERE NOT EXISTS (SELECT 1 FROM rm o WHERE o.gx = rm.gx + dx AND o.gz = rm.gz + dz)), "
    "bad AS (SELECT gx, gz, top FROM nb GROUP BY ALL HAVING min(step) < -2 OR greatest(coalesce(max(step) FILTER (abs(step) <= 2), 0), 0) - least(coalesce(min(step) FILTER (abs(step) <= 2), 0), 0) > 2) "
    "SELECT gx, gz, bottom, top, walkable AND (gx, gz, top) NOT IN (SELECT (gx, gz, top) FROM bad) AND (gx, gz) NOT IN (SELECT (gx, gz) FROM gap) AS walkable FROM rm"
)
def navmesh_ledges(spark, sf):
    low = navmesh.low_hanging(navmesh_spans(spark, sf), 2)
    return navmesh.ledges(navmesh.with_room(low), 2, 2).select("gx", "gz", "bottom", "top", "walkable")


def plain(spark: SparkSession, sf: str) -> DataFrame:
    """Walkable spans of a rising plain that grows with the events, each of which stands in the way on one column."""
    from splatlake.operators.navmesh import OPEN

    events = spark.read.parquet(f"{sf}/events.parquet").select(F.floor(F.col("event_id") / 12).cast("int").alias("gx"), ((F.col("event_id") * 37 + F.col("user_id")) % 120).cast("int").alias("gz"))
    layers = T.island_layers(spark, sf, 12)
    free = spark.range(layers * 120).select(F.floor(F.col("id") / 120).cast("int").alias("gx"), (F.col("id") % 120).cast("int").alias("gz")).join(events, ["gx", "gz"], "left_anti")
    return free.select("gx", "gz", F.floor(F.col("gx") / 16).cast("int").alias("top"), F.lit(OPEN).alias("room"))


PLAIN = "ev AS (SELECT DISTINCT CAST(event_id // 12 AS INTEGER) AS gx, CAST((event_id * 37 + user_id) % 120 AS INTEGER) AS gz FROM events), pl AS (SELECT CAST(x AS INTEGER) AS gx, CAST(z AS INTEGER) AS gz FROM (SELECT unnest(range(max(event_id) // 12 + 1)) AS x FROM events), range(120) r(z) EXCEPT SELECT * FROM ev)"


@query(
    f"WITH {PLAIN}, d(dx, dz) AS (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)), bd AS (SELECT pl.gx, pl.gz FROM pl, d, pl o WHERE o.gx = pl.gx + dx AND o.gz = pl.gz + dz GROUP BY ALL HAVING count(*) < 4 UNION SELECT * FROM pl WHERE NOT EXISTS (SELECT 1 FROM d, pl o WHERE o.gx = pl.gx + dx AND o.gz = pl.gz + dz)), "
    "o AS (SELECT a.i AS dx, b.j AS dz, 2 * greatest(abs(a.i), abs(b.j)) + least(abs(a.i), abs(b.j)) AS far FROM range(-10, 11) a(i), range(-10, 11) b(j)) "
    "SELECT pl.gx, pl.gz, CAST(pl.gx // 16 AS INTEGER) AS top, CAST(min(far) AS INTEGER) AS dist FROM bd, o, pl WHERE pl.gx = bd.gx + dx AND pl.gz = bd.gz + dz GROUP BY ALL"
)
def navmesh_distance(spark, sf):
    from splatlake.operators import navfield

    return navfield.border_distance(plain(spark, sf), 1, 4).select("gx", "gz", "top", "dist")


@query()
def navmesh_regions(spark, sf):
    from splatlake.operators import navfield

    field = navfield.border_distance(plain(spark, sf), 1, 4)
    return navfield.merge_regions(navfield.watershed(field, 1, 4), 1, 4, 16, 144).select("gx", "gz", "top", "dist", "region")


@query()
def navmesh_polygons(spark, sf):
    from splatlake.operators import navpoly

    return navpoly.merged_polygons(plain(spark, sf), 1, 4, 16, 144).select("region", "tx", "tz", "piece", "nth", "xs", "zs", "heights")


@query()
def navmesh_bake(spark, sf):
    floor_ = morph.floor_fill(T.island_cells(spark, sf))
    out = navmesh.bake_navmesh(mesh.face_mesh(floor_, lattice(spark, sf)), navmesh.NavmeshParams(agent_height=1.0, agent_radius=0.1, cell_size=0.5, cell_height=0.5, walkable_climb=1.0))
    return out if out is not None else spark.createDataFrame([], "tid long, " + ", ".join(f"{c} double" for c in mesh.CORNERS))


@query(
    "WITH n AS (SELECT count(*) AS n FROM orders), w AS (SELECT min(s) AS s FROM n, range(1, 3000) r(s) WHERE s * s * s >= n), c AS (SELECT unnest(range(n)) AS i FROM n) "
    "SELECT i AS splat_id, round(CAST(i % s - s * 0.5 AS DOUBLE) * 0.08, 6) + 0.0 AS x, round(CAST((i // s) % s AS DOUBLE) * 0.04, 6) AS y, round(CAST(i // (s * s) - s * 0.5 AS DOUBLE) * 0.08, 6) + 0.0 AS z, round(exp(ln((0.035 + (i % 11) * 0.001) * 0.8)), 6) AS sigma_2, round(((i % 100 + 80) / 255 - 0.5) / 0.2820948, 6) AS f_dc_0 FROM c, w"
)
def bench_scene(spark, sf):
    """The generated scene with as many splats as there are orders."""
    count = spark.read.parquet(f"{sf}/orders.parquet").count()
    return T.bench_scene(spark, count).select("splat_id", *[six(c).alias(c) for c in "xyz"], F.round(F.exp("scale_2"), 6).alias("sigma_2"), F.round("f_dc_0", 6).alias("f_dc_0"))


@query("SELECT profile, size, threshold, n / 2.0::DOUBLE AS seed_x, n / 4.0::DOUBLE AS seed_y FROM (VALUES ('object-prop', 0.05::DOUBLE, 0.1::DOUBLE), ('interior-room', 0.05, 0.1), ('outdoor-terrain', 0.05, 0.1)) t(profile, size, threshold), (SELECT count(*) AS n FROM supplier)")
def profile_configs(spark, sf):
    """Settings of each profile for a scene that is as long as there are suppliers, which is four metres."""
    from splatlake.plans.profiles import PROFILES, make_process_config

    n = spark.read.parquet(f"{sf}/supplier.parquet").count()
    configs = [(p, make_process_config(((0, 0, 0), (n, 0, 0)), 4.0, p, "y")) for p in PROFILES]
    return spark.createDataFrame([(p, c.voxel.size, c.voxel.opacity_threshold, *map(float, c.voxel_carve.seed_pos[:2])) for p, c in configs], "profile string, size double, threshold double, seed_x double, seed_y double")


@query(f"WITH {hits_cte(EMB, SIZE, THRESHOLD)}, {CELLS.format(t=THRESHOLD)}, k AS (SELECT cx, cy, cz FROM cells), d(dx, dy, dz) AS (VALUES (-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)) SELECT (SELECT count(*) FROM s) AS source_count, (SELECT count(*) FROM s) AS kept_count, (SELECT count(*) FROM k) AS solid_cells, (SELECT 2 * count(*) FROM k, d WHERE NOT EXISTS (SELECT 1 FROM k o WHERE o.cx = k.cx + dx AND o.cy = k.cy + dy AND o.cz = k.cz + dz)) AS triangles")
def manifest_metrics(spark, sf):
    from splatlake.plans.config import MeshConfig, NavmeshConfig, ProcessConfig, VoxelConfig
    from splatlake.plans.process import process_table

    config = ProcessConfig(voxel=VoxelConfig(size=SIZE, opacity_threshold=THRESHOLD), mesh=MeshConfig(mode="faces"), navmesh=NavmeshConfig(enabled=False))
    m = process_table(emb(spark, sf), config, errors=False).metrics
    return spark.createDataFrame([(m["sourceCount"], m["keptCount"], m["voxelSolidCells"], m["collisionTriangles"])], "source_count long, kept_count long, solid_cells long, triangles long")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""Meshes of solid cells: exposed faces, marching cubes, welding, merging of coplanar rectangles.

Meshes are tables of triangles (tid, ax, ay, az, bx, .., cz); corners are indexed by ``weld`` only when a
mesh is written.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splatlake.functions import expr as X
from splatlake.operators.components import connected_components
from splatlake.operators.tiles import places, roots, whole_tiles
from splatlake.operators.voxel import NEAR_TILE, ONE_TASK_EDGES, STEPS, Grid, with_rings

CORNERS = [f"{p}{c}" for p in "abc" for c in "xyz"]
# Corners of the quads of a cell's faces, 0 low and 1 high on each axis, in the order of STEPS.
QUADS = [
    [(0, 0, 1), (0, 0, 0), (0, 1, 0), (0, 1, 1)],
    [(1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 0)],
    [(0, 0, 0), (1, 0, 0), (1, 0, 1), (0, 0, 1)],
    [(0, 1, 1), (1, 1, 1), (1, 1, 0), (0, 1, 0)],
    [(1, 0, 0), (0, 0, 0), (0, 1, 0), (1, 1, 0)],
    [(0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)],
]


def exposed_faces(cells: DataFrame) -> DataFrame:
    """Faces between solid cells and free ones: cx, cy, cz, side (place in STEPS)."""
    return whole_tiles(with_rings(cells, (1, 1, 1)), ["tx", "ty", "tz"], _tile_faces, "cx int, cy int, cz int, side int")


def _tile_faces(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Exposed faces of the cells of some tiles; cells of the ring around a tile only hide faces."""
    tile = places(*[columns[f"t{c}"] for c in "xyz"])
    own, key, step = np.ones(len(tile), bool), tile, {}
    for c, n in zip("zyx", NEAR_TILE[::-1], strict=True):
        at = columns[f"c{c}"].astype(np.int64) - columns[f"t{c}"].astype(np.int64) * n
        own &= (at >= 0) & (at < n)
        key = key * (n + 2) + at + 1
        step = {k: v * (n + 2) for k, v in step.items()} | {c: 1}
    solid, mine = np.sort(key), np.flatnonzero(own)
    free = []
    for x, y, z in STEPS:
        other = key[mine] + x * step["x"] + y * step["y"] + z * step["z"]
        free.append(solid[np.minimum(np.searchsorted(solid, other), len(solid) - 1)] != other)
    row, side = np.nonzero(np.stack(free, 1))
    return {c: columns[c][mine[row]] for c in ("cx", "cy", "cz")} | {"side": side.astype(np.int32)}


def face_mesh(cells: DataFrame, grid: Grid) -> DataFrame:
    """Two triangles a face, with fixed winding and no shared corners."""
    faces = exposed_faces(cells)
    triangles = [[q[i] for i in t] for q in QUADS for t in ((0, 1, 2), (0, 2, 3))]
    table = F.array(*[F.array(*[F.lit(v) for p in t for v in p]) for t in triangles])
    out = faces.withColumn("nth", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("t", F.get(table, F.col("side") * 2 + F.col("nth")))
    place = [F.col("cx"), F.col("cy"), F.col("cz")]
    key = X.cell_key(grid, *place) * 12 + F.col("side") * 2 + F.col("nth")
    return out.select(key.alias("tid"), *[((place[k % 3] + F.get("t", F.lit(k))) * grid.size + grid.origin[k % 3]).alias(c) for k, c in enumerate(CORNERS)])


# Corners of a cube as (x, y, z) bits, and its edges as pairs of corners that differ on one axis.
_CUBE = [(k & 1, k >> 1 & 1, k >> 2 & 1) for k in range(8)]
_EDGES = [(a, b) for a in range(8) for b in range(a + 1, 8) if bin(a ^ b).count("1") == 1]


@functools.cache
def cube_cases() -> list[list[tuple[int, int, int]]]:
    """Triangles (three edges each) for each of 256 sets of solid corners, made by tracing the surface.

    On every face of the cube the surface runs between crossed edges with solid corners on its left;
    where all four edges are crossed, each solid corner is cut off by itself. The pieces close to loops,
    which are cut into fans. Winding is counter-clockwise seen from the free side.
    """
    edge = {frozenset(e): k for k, e in enumerate(_EDGES)}
    faces = []
    for axis in range(3):
        for high in (0, 1):
            u, v = (axis + 1) % 3, (axis + 2) % 3
            ring = []
            for pu, pv in ((0, 0), (1, 0), (1, 1), (0, 1)):
                bits = [0, 0, 0]
                bits[axis], bits[u], bits[v] = high, pu, pv
                ring.append(bits[0] | bits[1] << 1 | bits[2] << 2)
            faces.append(ring if high else ring[::-1])  # counter-clockwise from outside
    cases = []
    for case in range(256):
        solid, after = [case >> k & 1 for k in range(8)], {}
        for ring in faces:
            for k in range(4):
                # A run of solid corners that begins at k: the surface leaves by the edge after it and comes by the one before.
                if solid[ring[k]] and not solid[ring[k - 1]]:
                    end = k
                    while solid[ring[(end + 1) % 4]]:
                        end += 1
                    after[edge[frozenset((ring[k - 1], ring[k]))]] = edge[frozenset((ring[end % 4], ring[(end + 1) % 4]))]
        triangles, left = [], set(after)
        while left:
            start = min(left)
            loop, at = [start], after[start]
            left.discard(start)
            while at != start:
                loop.append(at)
                left.discard(at)
                at = after[at]
            triangles += [(loop[0], loop[k], loop[k + 1]) for k in range(1, len(loop) - 1)]
        cases.append(triangles)
    return cases


def cube_indices(cells: DataFrame) -> DataFrame:
    """Cubes between cell centres that the surface crosses: ux, uy, uz (lowest cell, from -1 on) and case (bit of each solid corner)."""
    corners = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z"), F.lit(1 << k).alias("bit")) for k, (x, y, z) in enumerate(_CUBE)])
    cubes = cells.withColumn("c", F.explode(corners)).select((F.col("cx") - F.col("c.x")).alias("ux"), (F.col("cy") - F.col("c.y")).alias("uy"), (F.col("cz") - F.col("c.z")).alias("uz"), F.col("c.bit").alias("bit"))
    return cubes.groupBy("ux", "uy", "uz").agg(F.sum("bit").cast("int").alias("case")).where(F.col("case") != 255)


def smooth_mesh(cells: DataFrame, grid: Grid) -> DataFrame:
    """Marching cubes of the binary field: corners are the middles of edges between cell centres."""
    middle = [tuple((a + b) / 2 for a, b in zip(_CUBE[i], _CUBE[j], strict=True)) for i, j in _EDGES]
    rows = [(case, n, *[v for e in t for v in middle[e]]) for case, ts in enumerate(cube_cases()) for n, t in enumerate(ts)]
    spark = cells.sparkSession
    table = spark.createDataFrame(rows, "`case` int, nth int, " + ", ".join(f"d{k} double" for k in range(9)))
    out = cube_indices(cells).join(F.broadcast(table), "case")  # a fixed table of under 1300 rows
    place = [F.col("ux"), F.col("uy"), F.col("uz")]
    padded = Grid(grid.origin, grid.size, tuple(n + 2 for n in grid.dims))
    key = X.cell_key(padded, *[p + 1 for p in place]) * 8 + F.col("nth")
    return out.select(key.alias("tid"), *[((place[k % 3] + F.col(f"d{k}") + 0.5) * grid.size + grid.origin[k % 3]).alias(c) for k, c in enumerate(CORNERS)])


def _corner_rows(mesh: DataFrame) -> DataFrame:
    """A row for each corner: tid, corner, x, y, z, qx, qy, qz."""
    corners = F.array(*[F.struct(F.lit(k).alias("corner"), *[F.col(f"{p}{c}").alias(c) for c in "xyz"]) for k, p in enumerate("abc")])
    out = mesh.select("tid", F.explode(corners).alias("v")).select("tid", "v.corner", "v.x", "v.y", "v.z")
    return out.withColumns({f"q{c}": X.quantize(F.col(c)) for c in "xyz"})


def weld(mesh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (qx, qy, qz, x, y, z), one for each place to a millionth (first by triangle and corner), and triangles of places."""
    rows = _corner_rows(mesh)
    vertices = rows.groupBy("qx", "qy", "qz").agg(F.min_by(F.struct("x", "y", "z"), F.struct("tid", "corner")).alias("v")).select("qx", "qy", "qz", "v.x", "v.y", "v.z")
    triangles = rows.groupBy("tid").agg(*[F.max(F.when(F.col("corner") == k, F.struct("qx", "qy", "qz"))).alias(p) for k, p in enumerate("abc")])
    return vertices, triangles


def _vectors(mesh: DataFrame) -> list[list[Column]]:
    return [[F.col(f"{p}{c}") for c in "xyz"] for p in "abc"]


def with_area(mesh: DataFrame) -> DataFrame:
    a, b, c = _vectors(mesh)
    n = X.cross(X.minus(b, a), X.minus(c, a))
    return mesh.withColumn("area", F.sqrt(X.dot(n, n)) / 2)


def planes(mesh: DataFrame) -> DataFrame:
    """Triangles that lie in a plane across an axis, with axis, sign, coord (in millionths) and area."""
    a, b, c = _vectors(mesh)
    n = X.cross(X.minus(b, a), X.minus(c, a))
    out = X.computed(mesh, mesh.columns, {f"n{k}": v for k, v in enumerate(n)} | {"size": F.sqrt(X.dot(n, n))}).where("size > 1e-12")
    axis, sign, coord = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("double")
    for k, name in reversed(list(enumerate("xyz"))):
        flat = (F.abs(F.col(f"n{k}")) / F.col("size") >= 0.999) & (F.abs(F.col(f"b{name}") - F.col(f"a{name}")) <= 1e-5) & (F.abs(F.col(f"c{name}") - F.col(f"a{name}")) <= 1e-5)
        axis = F.when(flat, F.lit(k)).otherwise(axis)
        sign = F.when(flat, F.signum(f"n{k}").cast("int")).otherwise(sign)
        coord = F.when(flat, F.col(f"a{name}")).otherwise(coord)
    return X.computed(out, mesh.columns, {"axis": axis, "sign": sign, "coord": X.quantize(coord), "area": F.col("size") / 2}).where("axis IS NOT NULL")


#: Sides of the mean triangle that a tile of a plane is wide, where its width isn't given.
TILE_SIDES = 128
_FLAT = [f"{p}{n}" for p in "abc" for n in "uv"]
_CARRIED = {"axis": "int", "sign": "int", "area": "double", "lou": "double", "hiu": "double", "lov": "double", "hiv": "double", "at": "double"}


def _tile_pieces(side: float):
    """Kernel: triangles of some tiles of planes with ``root``, the smallest tid that each is connected with by edges of its tile.

    An edge is of the tile in which its smaller end lies, so that all triangles at an edge are seen together.
    """

    def kernel(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        order = np.argsort(columns["tid"], kind="stable")
        columns = {c: v[order] for c, v in columns.items()}
        plane = (columns["coord"].astype(np.int64) * 4 + columns["axis"]) * 4 + columns["sign"]
        # Points by their number in order of u and v.
        u, v = (np.concatenate([columns[f"q{p}{n}"] for p in "abc"]) for n in "uv")
        point, n = places(u, v), len(plane)
        at = np.arange(n)
        a, b = (np.concatenate([at + k * n for k in ks]) for ks in ((0, 1, 0), (1, 2, 2)))
        a, b = np.where(point[a] <= point[b], a, b), np.where(point[a] <= point[b], b, a)
        of = np.tile(at, 3)
        here = (np.floor(u[a] / side) == columns["tu"][of]) & (np.floor(v[a] / side) == columns["tv"][of])
        low, high, of = point[a[here]], point[b[here]], of[here]
        by = np.lexsort((high, low, plane[of]))
        low, high, of = low[by], high[by], of[by]
        same = (low[1:] == low[:-1]) & (high[1:] == high[:-1]) & (plane[of[1:]] == plane[of[:-1]])
        found = roots(of[:-1][same], of[1:][same], len(at))
        return {"tid": columns["tid"], "root": columns["tid"][found], "shared": columns["shared"], "nth": columns["nth"]} | {c: columns[c] for c in _CARRIED}

    return kernel


def coplanar_pieces(mesh: DataFrame, tile: float | None = None, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """Triangles that lie in planes, with their piece: the smallest tid of those connected by edges in a plane; axis, sign, area, box (lou .. hiv) and place (at).

    Planes are cut into tiles of a task each; the star rounds see only the pieces of triangles whose edges lie in several tiles.
    """
    from splatlake.functions.storage import written

    on = lambda p, n: F.when(F.col("axis") == 0, F.col(f"{p}{'yz'[n]}")).when(F.col("axis") == 1, F.col(f"{p}{'xz'[n]}")).otherwise(F.col(f"{p}{'xy'[n]}"))
    flat = planes(mesh)
    flat = X.computed(flat, ["tid", "axis", "sign", "coord", "area"], {f"{p}{c}": on(p, n) for p in "abc" for n, c in enumerate("uv")} | {"at": F.when(F.col("axis") == 0, F.col("ax")).when(F.col("axis") == 1, F.col("ay")).otherwise(F.col("az"))})
    if tile is None:
        mean = flat.agg(F.avg("area")).head()[0]
        tile = TILE_SIDES * (2 * mean) ** 0.5 if mean else 1.0
    side = max(1.0, tile * 1e6)
    box = {f"{m}{n}": f(*[f"{p}{n}" for p in "abc"]) for m, f in (("lo", F.least), ("hi", F.greatest)) for n in "uv"}
    flat = X.computed(flat, ["tid", "axis", "sign", "coord", "area", "at"], {f"q{c}": X.quantize(F.col(c)) for c in _FLAT} | box)
    corner = lambda p: F.struct(F.col(f"q{p}u").alias("u"), F.col(f"q{p}v").alias("v"))
    low = [F.least(corner(p), corner(q)) for p, q in ("ab", "bc", "ac")]
    tiles = F.array_distinct(F.array(*[F.struct(F.floor(e["u"] / side).cast("long").alias("tu"), F.floor(e["v"] / side).cast("long").alias("tv")) for e in low]))
    names = ["tid", "coord", *[f"q{c}" for c in _FLAT], *_CARRIED]
    rows = flat.select(*names, tiles.alias("tiles")).select(*names, (F.size("tiles") > 1).alias("shared"), F.posexplode("tiles").alias("nth", "t"))
    rows = rows.select(*names, "shared", "nth", "t.tu", "t.tv", F.xxhash64("axis", "sign", "coord", "t").alias("tile"))
    solved = written(whole_tiles(rows, ["tile"], _tile_pieces(side), "tid long, root long, shared boolean, nth int, " + ", ".join(f"{c} {t}" for c, t in _CARRIED.items())), "pieces")
    several = solved.where("shared").groupBy("tid").agg(F.array_sort(F.collect_set("root")).alias("roots"))  # at most three
    found = connected_components(several.select(F.col("roots")[0].alias("a"), F.explode(F.slice("roots", 2, 2)).alias("b")), one_task=one_task)
    own = solved.where("nth = 0")
    return own.join(found, own["root"] == found["node"], "left").select("tid", F.coalesce("component", "root").alias("piece"), *_CARRIED)


def merge_rectangles(mesh: DataFrame, tile: float | None = None) -> DataFrame:
    """Connected coplanar pieces of over two triangles that fill a rectangle become two triangles each. ``tile`` is the width of a task's share of a plane."""
    from splatlake.functions.storage import written

    flat = coplanar_pieces(mesh, tile)
    pieces = flat.groupBy("piece", "axis", "sign").agg(F.count("*").alias("n"), F.sum("area").alias("area"), *[f(f"{m}{n}").alias(f"{m}{n}") for m, f in (("lo", F.min), ("hi", F.max)) for n in "uv"], F.min_by("at", "tid").alias("at"))
    rect = (F.col("hiu") - F.col("lou")) * (F.col("hiv") - F.col("lov"))
    good = (F.col("n") > 2) & (rect > 1e-8) & (F.abs(F.col("area") - rect) <= F.greatest(rect, F.lit(1.0)) * 1e-4)
    merged = written(pieces.where(good), "merged")
    gone = flat.join(merged.select("piece"), "piece", "left_semi").select("tid")
    quads = {1: [(0, 0), (1, 0), (1, 1), (0, 1)], -1: [(0, 0), (0, 1), (1, 1), (1, 0)]}
    # (x, z) is a left-handed pair for the y axis, so its winding is the other way round.
    # A table of which corner of the rectangle (bits u, v) each of the six corners is, for each axis and sign.
    picks = [[bits for t in ((0, 1, 2), (0, 2, 3)) for k in t for bits in quads[-sign if axis == 1 else sign][k]] for axis in range(3) for sign in (-1, 1)]
    table = F.array(*[F.array(*map(F.lit, row)) for row in picks])
    merged = X.computed(merged, merged.columns, {"bits": F.get(table, F.col("axis") * 2 + F.when(F.col("sign") > 0, 1).otherwise(0))})
    rows = []
    for t in range(2):
        cols = []
        for k in range(3):
            at = [F.when(F.get("bits", F.lit(6 * t + 2 * k + n)) == 1, F.col(f"hi{c}")).otherwise(F.col(f"lo{c}")) for n, c in enumerate("uv")]
            cols += [F.when(F.col("axis") == 0, F.col("at")).otherwise(at[0]), F.when(F.col("axis") == 0, at[0]).when(F.col("axis") == 1, F.col("at")).otherwise(at[1]), F.when(F.col("axis") == 2, F.col("at")).otherwise(at[1])]
        rows.append(F.struct((F.col("piece") if t == 0 else -F.col("piece") - 1).alias("tid"), *[c.alias(n) for c, n in zip(cols, CORNERS, strict=True)]))
    new = merged.select(F.explode(F.array(*rows)).alias("t")).select("t.*")
    return mesh.select("tid", *CORNERS).join(gone, "tid", "left_anti").union(new.select("tid", *CORNERS))


def extract_mesh(cells: DataFrame, grid: Grid, mode: str) -> DataFrame:
    if mode == "faces":
        return face_mesh(cells, grid)
    if mode == "smooth":
        return merge_rectangles(smooth_mesh(cells, grid), TILE_SIDES * grid.size)
    raise ValueError(f"unknown mesh mode {mode}")

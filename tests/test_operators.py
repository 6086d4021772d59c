"""Operators against known results and brute force."""

import itertools
import math

import numpy as np
import pytest

from splatlake.functions import expr as X
from splatlake.operators import evaluate, filters, mesh, morph, navmesh, voxel
from splatlake.sources import tables

SCHEMA = "splat_id long, " + ", ".join(f"{c} double" for c in X.SCALARS) + ", f_rest array<double>"


def splats(spark, rows):
    """Rows (x, y, z, deviations, opacity, quaternion)."""
    out = [(i, *map(float, p), *[math.log(s) for s in sigma], float(o), 0.0, 0.0, 0.0, *map(float, q), []) for i, (p, sigma, o, q) in enumerate(rows)]
    return spark.createDataFrame(out, SCHEMA)


def cells(spark, rows):
    return spark.createDataFrame(list(rows), "cx int, cy int, cz int")


def grid(*dims):
    return voxel.Grid((0.0, 0.0, 0.0), 1.0, dims)


def rows(df):
    return sorted(tuple(r) for r in df.select("cx", "cy", "cz").collect())


ONE = (1, 0, 0, 0)
ROOM = [c for c in itertools.product(range(5), repeat=3) if 0 in c or 4 in c]


def test_single_splat_voxels_and_faces(spark):
    s = splats(spark, [((0, 0, 0), (0.3,) * 3, math.log((1 - 1e-6) / 1e-6), ONE)])
    g = voxel.grid_of(s, 0.25)
    c = voxel.solid_cells(s, g, 0.05)
    assert g.dims == (8, 8, 8) and c.count() == 88 and mesh.face_mesh(c, g).count() == 288


def test_cluster_and_floaters(spark):
    s = splats(spark, [((x, 0, 0), (0.75,) * 3, 8, ONE) for x in (0, 1, 10)])
    r = voxel.cluster_filter(s, 1.0, 0.001, (0, 0, 0))
    assert r.grid.dims == (20, 8, 8) and r.component.count() == 112 and r.splats.count() == 2
    far = voxel.cluster_filter(s, 1.0, 0.001, (3.5, 3.5, 0))
    assert far.splats.count() == 2 and far.requested != far.resolved
    g = voxel.grid_of(s, 0.5)
    c = voxel.solid_cells(s, g, 0.001)
    assert c.count() == 1568 and voxel.floater_filter(s, c, g, 0.001, 0.001).count() == 3
    with pytest.raises(ValueError):
        voxel.cluster_filter(s, 0.0, 0.1, (0, 0, 0))


def test_boxes_and_rotation(spark):
    h = math.sqrt(0.5)
    b = filters.gaussian_bounds(splats(spark, [((0, 0, 0), (2, 1, 0.5), 0, (h, 0, 0, h))])).head()
    assert [round(b[f"hi_{c}"], 5) for c in "xyz"] == [3, 6, 1.5]
    a = filters.Alignment.of(scale_points=((0, 0, 0), (4, 0, 0)), scale_distance=2.0)
    assert a.scale == 0.5
    assert np.allclose(filters.rotate(filters.Alignment.of("z", (0, 1, 0)).rotation, (0, 1, 0)), (0, 0, 1))
    assert np.allclose(filters.rotate(filters.Alignment.of("neg-y", (0, 1, 0)).rotation, (0, 1, 0)), (0, -1, 0))
    with pytest.raises(ValueError):
        filters.Alignment.of(scale_points=((0, 0, 0), (0, 0, 0)), scale_distance=2.0)
    moved = filters.transform_scene(splats(spark, [((1, 0, 0), (1, 1, 1), 0, ONE)]), filters.SceneTransform((0, 0, 90), (0, 2, 0))).head()
    assert np.allclose([moved[c] for c in "xyz"], (0, 3, 0))


def test_nan_rows_are_dropped(spark):
    s = splats(spark, [((float("nan"), 0, 0), (1, 1, 1), 0, ONE), ((0, 0, 0), (1, 1, 1), float("nan"), ONE), ((0, 0, 0), (1, 1, 1), 8, ONE)])
    assert [r["splat_id"] for r in filters.finite_filter(s).collect()] == [2]
    assert filters.opacity_filter(s, 0.5).where("splat_id = 1").count() == 0


def test_fill_and_carve(spark):
    room = cells(spark, ROOM)
    assert morph.exterior_fill(room, grid(5, 5, 5), 0.0, (2.5,) * 3).cells.where("cx = 2 AND cy = 2 AND cz = 2").count() == 0
    opened = cells(spark, [c for c in ROOM if c != (0, 2, 2)])
    assert morph.exterior_fill(opened, grid(5, 5, 5), 0.0, (2.5,) * 3).warnings == [morph.FILL_LEAK]
    assert morph.exterior_fill(room, grid(5, 5, 5), 0.0, (99,) * 3).warnings == [morph.FILL_OUTSIDE]
    c = morph.carve(room, grid(5, 5, 5), 1.0, 0.0, (2.5,) * 3)
    assert voxel.expand_runs(c.reachable).count() == 9 and c.cells.count() == 12
    block = cells(spark, itertools.product(range(3), repeat=3))
    assert morph.carve(block, grid(3, 3, 3), 1.0, 0.0, (1.5,) * 3).warnings == [morph.CARVE_NO_FREE]
    wall = cells(spark, [(3, y, z) for y in range(3) for z in range(3) if (y, z) != (1, 1)] + [(5, 1, 1)])
    gap = morph.carve(wall, grid(7, 3, 3), 1.0, 1.0, (1.5,) * 3)
    assert voxel.expand_runs(gap.reachable).count() == 4 and gap.cells.count() == 0
    assert rows(morph.floor_fill(cells(spark, [(0, 2, 0)]))) == [(0, 0, 0), (0, 1, 0), (0, 2, 0)]
    assert morph.crop(cells(spark, [(4, 2, 1)]), grid(6, 5, 4))[1].origin == (4.0, 2.0, 1.0)


def test_random_floods_match_brute_force(spark):
    rng = np.random.default_rng(4)
    dims = (6, 5, 4)
    solid = {tuple(map(int, c)) for c in np.argwhere(rng.random(dims) < 0.45)}
    free = set(itertools.product(*map(range, dims))) - solid
    todo = [c for c in free if any(v in (0, n - 1) for v, n in zip(c, dims, strict=True))]
    outside = set()
    while todo:
        c = todo.pop()
        if c in free and c not in outside:
            outside.add(c)
            todo += [tuple(a + b for a, b in zip(c, s, strict=True)) for s in voxel.STEPS]
    found = rows(voxel.expand_runs(morph.outside_runs(cells(spark, sorted(solid)), grid(*dims))))
    assert found == sorted(outside)
    r = 1
    near = {c for c in itertools.product(*map(range, dims)) if any(max(abs(a - b) for a, b in zip(c, s, strict=True)) <= r for s in solid)}
    assert rows(morph.dilate(cells(spark, sorted(solid)), grid(*dims), r)) == sorted(near)


def volume(m):
    t = np.array([list(r) for r in m.select(*mesh.CORNERS).collect()]).reshape(-1, 3, 3)
    return abs(np.einsum("ij,ij->i", t[:, 0], np.cross(t[:, 1], t[:, 2])).sum() / 6), len(t)


def test_meshes(spark):
    assert mesh.face_mesh(cells(spark, [(0, 0, 0), (1, 0, 0)]), grid(2, 1, 1)).count() == 20
    plate = cells(spark, [(x, y, 0) for x in range(4) for y in range(3)])
    smooth = mesh.smooth_mesh(plate, grid(4, 3, 1))
    merged = mesh.merge_rectangles(smooth)
    (before, n), (after, m) = volume(smooth), volume(merged)
    assert m < n and abs(before - after) < 1e-9 and before > 0
    # A closed surface: every edge is used once in each direction.
    edges = {}
    for r in smooth.select(*mesh.CORNERS).collect():
        p = [tuple(r[3 * k : 3 * k + 3]) for k in range(3)]
        for a, b in zip(p, p[1:] + p[:1], strict=True):
            edges[a, b] = edges.get((a, b), 0) + 1
    assert all(edges.get((b, a)) == k for (a, b), k in edges.items())
    assert mesh.smooth_mesh(cells(spark, []), grid(2, 2, 2)).count() == 0
    assert len(mesh.cube_cases()) == 256 and not mesh.cube_cases()[0] and not mesh.cube_cases()[255]


def test_distances(spark):
    t = np.array([[0.0, 0, 0, 1, 0, 0, 0, 0, 1]])
    assert evaluate.triangle_distances(np.array([[0.25, 0, 0.25]]), t)[0, 0] < 1e-9
    rng = np.random.default_rng(2)
    tri, points = rng.normal(size=(3, 9)), rng.normal(size=(4, 3))
    u, v = (g.ravel() for g in np.meshgrid(np.linspace(0, 1, 200), np.linspace(0, 1, 200)))
    u, v = u[u + v <= 1], v[u + v <= 1]
    for i, j in itertools.product(range(4), range(3)):
        a, b, c = tri[j].reshape(3, 3)
        dense = np.sqrt(((a + u[:, None] * (b - a) + v[:, None] * (c - a) - points[i]) ** 2).sum(1)).min()
        assert abs(evaluate.triangle_distances(points, tri)[i, j] - dense) < 0.02
    empty = evaluate.error_summary(spark.createDataFrame([], "splat_id long, distance double")).head()
    assert tuple(empty) == (0, 0.0, 0.0, 0.0)


def test_sample_and_bench_scene(spark):
    s = tables.bench_scene(spark, 9000)
    assert evaluate.stride_sample(s, 4096).count() == 4096
    few = tables.bench_scene(spark, 8)
    assert few.count() == 8 and voxel.solid_cells(few, voxel.grid_of(few, 0.05), 0.05).count() > 0


def test_navmesh(spark):
    quad = lambda p: spark.createDataFrame([(0, *p[0], *p[1], *p[2]), (1, *p[0], *p[2], *p[3])], "tid long, " + ", ".join(f"{c} double" for c in mesh.CORNERS))
    floor = quad([(0.0, 0.0, 0.0), (0.0, 0.0, 4.0), (4.0, 0.0, 4.0), (4.0, 0.0, 0.0)])
    assert navmesh.bake_navmesh(floor, navmesh.NavmeshParams()).count() > 0
    wall = quad([(0.0, 0.0, 0.0), (0.0, 4.0, 0.0), (4.0, 4.0, 0.0), (4.0, 0.0, 0.0)])
    assert navmesh.bake_navmesh(wall, navmesh.NavmeshParams()) is None


def test_one_axis():
    t = filters.SceneTransform().with_axis("translation", 1, 2).with_axis("rotation", 2, 90.0)
    assert t == filters.SceneTransform((0.0, 0.0, 90.0), (0.0, 2.0, 0.0)) and not t.is_identity
    assert t.with_axis("translation", 1, float("nan")).with_axis("rotation", 2, float("inf")).is_identity


def test_error_summary(spark):
    for n in (0, 1, 2, 21, 500):
        values = [((k * 37) % 101) / 8 for k in range(n)]
        found = evaluate.error_summary(spark.createDataFrame([(v,) for v in values], "distance double")).head()
        want = sorted(values)[math.floor((n - 1) * 0.95 + 0.5)] if n else 0.0
        mean = sum(values) / n if n else 0.0
        assert (found.sample_count, found.p95) == (n, want) and math.isclose(found["mean"], mean) and math.isclose(found.rms, math.sqrt(sum(v * v for v in values) / n) if n else 0.0)

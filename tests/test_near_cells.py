"""Cells grown and faces found tile by tile, against plain versions; scenes reach over the sides of tiles and of the grid."""

import random

import pytest

from splatlake import queries as Q
from splatlake.operators import mesh, morph, navmesh, voxel

DIMS = (140, 40, 70)


def scene(spark, seed=6):
    rng = random.Random(seed)
    cells = {(0, 0, 0), (139, 39, 69), (64, 31, 32), (63, 32, 31), (-1, 3, 3)} | {tuple(rng.choice(v) for v in ((62, 63, 64, 65, 127, 128, 5), (30, 31, 32, 33, 2), (30, 31, 32, 63, 64, 65))) for _ in range(120)}
    return cells, spark.createDataFrame(sorted(cells), "cx int, cy int, cz int"), voxel.Grid((0.0, 0.0, 0.0), 1.0, DIMS)


def rows(df):
    out = [tuple(r) for r in df.collect()]
    assert len(set(out)) == len(out)
    return set(out)


def inside(c):
    return all(0 <= v < n for v, n in zip(c, DIMS, strict=True))


@pytest.mark.parametrize("r", [1, 5])
def test_growth_over_tiles(spark, r):
    cells, df, grid = scene(spark)
    span = range(-r, r + 1)
    assert rows(morph.dilate(df, grid, r)) == {o for x, y, z in cells for i in span for j in span for k in span if inside(o := (x + i, y + j, z + k))}
    disc = [(i, k) for i in span for k in span if i * i + k * k <= r * r]
    assert rows(morph.capsule_solid(df, grid, r, 2)) == {o for x, y, z in cells for i, k in disc for j in range(-2, 3) if inside(o := (x + i, y + j, z + k))}


def test_faces_over_tiles(spark):
    cells, df, _ = scene(spark)
    want = {(*c, k) for c in cells for k, s in enumerate(voxel.STEPS) if tuple(a + b for a, b in zip(c, s, strict=True)) not in cells}
    assert rows(mesh.exposed_faces(df)) == want


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_grown_cells_are_not_shuffled(spark):
    """Only the solid cells go through a shuffle; what grows from them is made by the task of its tile."""
    _, df, grid = scene(spark)
    for grown in (morph.dilate(df, grid, 1), morph.capsule_solid(df, grid, 1, 1), mesh.exposed_faces(df)):
        text = plan(grown)
        assert "Aggregate" not in text and "Join" not in text and text.count("Repartition") == 1
    blocked = plan(Q.capsule_blocked(spark, "/root/testdata/sf0.001"))
    assert "Aggregate" not in blocked.split("MapInArrow")[0]


def test_filled_cells_are_not_made_different_again(spark):
    room = [(x, y, z) for x in range(5) for y in range(5) for z in range(5) if {x, y, z} & {0, 4}]
    grid = voxel.Grid((0.0, 0.0, 0.0), 1.0, (9, 7, 7))
    df = spark.createDataFrame([(x + 1, y + 1, z + 1) for x, y, z in room], "cx int, cy int, cz int")
    full = morph.exterior_fill(df, grid, 0.0, (3.5, 3.5, 3.5)).cells
    assert full.count() == 9 * 7 * 7 - 27 and full.distinct().count() == 9 * 7 * 7 - 27
    assert not plan(full).startswith("Aggregate")


def test_spans_take_the_slope_from_their_own_triangle(spark):
    _, df, grid = scene(spark)
    assert "Join" not in plan(navmesh.spans(mesh.face_mesh(df, grid), navmesh.NavmeshParams(cell_size=1.0, cell_height=1.0)))

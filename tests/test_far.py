"""Cells far from zero: places, distances and planes there stay apart."""

from pyspark.sql import functions as F

from splatlake.operators import mesh, voxel

FAR = 3_000_000


def far(spark, cells):
    return spark.createDataFrame([(x + FAR, y, z) for x, y, z in cells], "cx int, cy int, cz int")


def test_places_far_out_are_welded_apart(spark):
    grid = voxel.Grid((0.0, 0.0, 0.0), 1.0, (1 << 23, 8, 8))
    vertices, triangles = mesh.weld(mesh.face_mesh(far(spark, [(0, 0, 0), (2, 0, 0)]), grid))
    assert vertices.count() == 16 and vertices.select("qx", "qy", "qz").distinct().count() == 16 and triangles.count() == 24
    assert vertices.select(F.min("x"), F.max("x")).head() == (FAR, FAR + 3)


def test_nearest_cell_far_out(spark):
    assert voxel.nearest_solid(far(spark, [(0, 5, 5), (-50_000, 1, 1), (9, 9, 9)]), (11, 7, 9)) == (FAR - 50_000, 1, 1)


def test_planes_far_out_merge_apart(spark):
    grid = voxel.Grid((0.0, 0.0, 0.0), 1.0, (1 << 23, 8, 8))
    boxes = [(x + 300 * k, y, z) for k in range(4) for x in range(3 + k) for y in range(2) for z in range(3)]
    m = mesh.face_mesh(far(spark, boxes), grid)
    merged = mesh.merge_rectangles(m)
    assert merged.count() == 4 * 12
    assert mesh.with_area(merged).agg(F.sum("area")).head()[0] == mesh.with_area(m).agg(F.sum("area")).head()[0]
    assert mesh.planes(merged).where("axis = 0").select("coord").distinct().count() == 8

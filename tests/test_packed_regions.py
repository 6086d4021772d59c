"""Polygons by one look at tiles against those of fields found round by round, whatever the order of spans."""

import random

import pytest
import test_tiles as plain

from splatlake.operators import navfield, navpoly

NAMES = ["region", "tx", "tz", "piece", "nth", "xs", "zs", "heights"]


def rows(found):
    return sorted((r.region, r.tx, r.tz, r.piece, r.nth, *map(tuple, (r.xs, r.zs, r.heights))) for r in found.select(NAMES).collect())


def by_rounds(spark, spans, climb, tall):
    found = navfield.watershed(navfield.border_distance(plain.frame(spark, spans), climb, tall), climb, tall)
    return rows(navpoly.region_polygons(navfield.merge_regions(found, climb, tall, 16, 144), climb, tall))


def rough(seed=9):
    rng = random.Random(seed)
    return [(x, z, 0, 100) for x in range(100, 300) for z in range(-20, 20) if rng.random() < 0.88]


def test_order_of_spans(spark):
    spans = rough()
    found = []
    for part in (spans, random.Random(1).sample(spans, len(spans))):
        frame = spark.createDataFrame([(*s, 1, plain.number(s[:3])) for s in part], "gx int, gz int, top int, room int, region long, id long").coalesce(1)
        found.append(rows(navpoly.region_polygons(frame, 1, 4)))
    assert found[0] == found[1]


@pytest.mark.parametrize("far", [0, 2_900_000])
def test_polygons_at_once(spark, far):
    for spans, climb, tall in ((rough(), 1, 4), (plain.ground(), 2, 6)):
        spans = [(x + far, z, t, r) for x, z, t, r in spans]
        assert navfield.packed_regions(plain.frame(spark, spans), climb, tall, 16, 144) is not None
        assert rows(navpoly.merged_polygons(plain.frame(spark, spans), climb, tall, 16, 144)) == by_rounds(spark, spans, climb, tall)


def hall():
    return [(x, z, 0, 100) for x in range(97, 163) for z in range(-35, 33)]


def test_tiles_that_need_wider_rings(spark, monkeypatch):
    again = []
    own = navfield._again
    monkeypatch.setattr(navfield, "_again", lambda parts: again.append(1) or own(parts))
    spans = hall() + [(x + 150, *s) for x, *s in rough()]
    want = by_rounds(spark, spans, 1, 4)
    assert rows(navpoly.merged_polygons(plain.frame(spark, spans), 1, 4, 16, 144)) == want and again == [1]
    # Rings that are still too narrow, and too many such tiles.
    monkeypatch.setattr(navfield, "WIDEST", 20)
    assert rows(navpoly.merged_polygons(plain.frame(spark, spans), 1, 4, 16, 144)) == want and again == [1, 1]
    monkeypatch.setattr(navfield, "FEW_OPEN", 0)
    assert navfield.packed_regions(plain.frame(spark, spans), 1, 4, 16, 144) is None and again == [1, 1]


def test_merging_by_tiles(spark, monkeypatch):
    rng = random.Random(4)
    at = [(x, z) for x in range(0, 600, 60) for z in range(-300, 300, 60)]
    nodes = [plain.number((x, z, 0)) for x, z in at]
    edges = [(a, b) for a in nodes if rng.random() < 0.7 and (b := nodes[(nodes.index(a) + rng.choice([1, 1, 2, 10])) % len(nodes)]) != a]
    monkeypatch.setattr(navfield, "ONE_TASK_EDGES", 20)
    found = navfield._united(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, found.collect())) == sorted(plain.united({n for e in edges for n in e}, edges).items())


def test_no_spans(spark):
    assert navpoly.merged_polygons(plain.frame(spark, []), 1, 4, 16, 144).count() == 0

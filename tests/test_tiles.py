"""Components by tiles, and the fields and polygons of the navigation mesh, against plain versions. Scenes reach over the sides of tiles."""

import collections
import heapq
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from splatlake.operators import components, mesh, navfield, navmesh, navpoly, tiles, voxel


def united(nodes, edges):
    """Smallest node that each is connected with."""
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def test_roots_and_overlaps():
    rng = np.random.default_rng(3)
    for n in (1, 5, 60):
        a, b = rng.integers(0, n, (2, n))
        assert tiles.roots(a, b, n).tolist() == list(united(range(n), zip(a.tolist(), b.tolist(), strict=True)).values())
    begin = np.array([0, 5, 20, 33])
    end = np.array([3, 9, 28, 39])
    i, j = tiles.overlaps(begin, end, 10)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(2, 3)] and tiles.places(np.array([2, 1, 2]), np.array([0, 5, 0])).tolist() == [1, 0, 1]


@pytest.mark.parametrize("one_task", [0, 1 << 20])
def test_components_of_edges(spark, one_task):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1100)] + [(7, 7)]
    own = [e for e in edges if e[0] != e[1]]
    found = components.connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long"), one_task=one_task)
    assert dict(map(tuple, found.collect())) == united({n for e in own for n in e}, own)
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), one_task=one_task).count() == 0


@pytest.mark.parametrize("one_task", [0, 1 << 20])
def test_components_of_cells_over_tiles(spark, one_task):
    rng = random.Random(2)
    cells = set()
    for _ in range(25):
        c = [rng.choice([1020, 2046, 30, 5]), rng.choice([30, 62, 3]), rng.choice([31, 60, 10])]
        for _ in range(90):
            k = rng.randrange(3)
            c[k] = max(0, c[k] + rng.choice([-1, 1]))
            cells.add(tuple(c))
    cells |= {(x, 50, 50) for x in range(1000, 2100)}
    grid = voxel.Grid((0.0, 0.0, 0.0), 1.0, (3000, 100, 100))
    key = lambda c: (c[2] * 100 + c[1]) * 3000 + c[0]
    steps = [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
    edges = [(key(c), key(o)) for c in cells for s in steps if (o := tuple(a + b for a, b in zip(c, s, strict=True))) in cells]
    want = united([key(c) for c in cells], edges)
    runs = voxel.labelled_runs(voxel.x_runs(spark.createDataFrame(sorted(cells), "cx int, cy int, cz int")), grid, one_task=one_task)
    found = {key((x, r.cy, r.cz)): r.component for r in runs.collect() for x in range(r.x0, r.x1 + 1)}
    assert found == want and len(set(want.values())) > 3
    seed = min(cells)
    own = {key(tuple(r)) for r in voxel.component_of(spark.createDataFrame(sorted(cells), "cx int, cy int, cz int"), grid, seed).select("cx", "cy", "cz").collect()}
    assert own == {n for n, c in want.items() if c == want[key(seed)]}


@pytest.mark.parametrize("one_task", [0, 1 << 20])
def test_coplanar_pieces_over_tiles(spark, one_task):
    rng = random.Random(4)
    cells = {(x, y, 0) for x in range(-9, 10) for y in range(-8, 9) if rng.random() < 0.62} | {(20, y, z) for y in range(7) for z in range(7)}
    m = mesh.face_mesh(spark.createDataFrame(sorted(cells), "cx int, cy int, cz int"), voxel.Grid((0.0, 0.0, 0.0), 1.0, (64, 64, 64))).select(F.row_number().over(Window.orderBy("ax", "ay", "az", "bx", "by", "bz", "cx", "cy", "cz")).cast("long").alias("tid"), *mesh.CORNERS)
    flat = mesh.planes(m).collect()
    at = collections.defaultdict(list)
    for r in flat:
        v = [tuple(r[f"{p}{c}"] for c in "xyz") for p in "abc"]
        for a, b in ((0, 1), (1, 2), (0, 2)):
            at[r.axis, r.sign, r.coord, tuple(sorted((v[a], v[b])))].append(r.tid)
    want = united([r.tid for r in flat], [(t[0], o) for t in at.values() for o in t[1:]])
    for tile in (3.0, 100.0, None):
        assert {r.tid: r.piece for r in mesh.coplanar_pieces(m, tile, one_task).collect()} == want
    merged = mesh.merge_rectangles(m, 3.0)
    before, after = (mesh.with_area(t).agg(F.round(F.sum("area"), 6)).head()[0] for t in (m, merged))
    assert before == after and merged.where("ax >= 20 AND bx >= 20 AND cx >= 20").count() == 12


# Navigation


def plain_links(spans, climb, tall):
    """Like ``navfield.links``, on dictionaries."""
    columns = collections.defaultdict(list)
    for gx, gz, top, room in spans:
        columns[gx, gz].append((top, room))
    out = {}
    for gx, gz, top, room in spans:
        out[gx, gz, top] = row = []
        for dx, dz in navfield.STEPS:
            fits = [(abs(t - top), t) for t, r in columns[gx + dx, gz + dz] if abs(t - top) <= climb and min(top + room, t + r) - max(top, t) >= tall]
            row.append((gx + dx, gz + dz, min(fits)[1]) if fits else None)
    return out


def plain_distance(link):
    dist = {s: 0 for s, l in link.items() if None in l}
    queue = [(0, s) for s in dist]
    back = collections.defaultdict(list)
    for s, l in link.items():
        for k, o in enumerate(l):
            if o:
                back[o].append((s, 2))
                back[link[o][(k + 1) % 4]].append((s, 3))
                back[link[o][(k + 3) % 4]].append((s, 3))
    while queue:
        d, s = heapq.heappop(queue)
        if d > dist[s]:
            continue
        for o, w in back[s]:
            if d + w < dist.get(o, 1 << 30):
                dist[o] = d + w
                heapq.heappush(queue, (d + w, o))
    return dist


def number(s):
    return ((s[0] + (1 << 20) << 21) + s[1] + (1 << 20) << 21) + s[2] + (1 << 20)


def plain_watershed(link, dist):
    """Region (smallest id) of each span: pairs of a span and what it drains to, joined."""
    edges, plateau = [], {}
    for s, l in link.items():
        higher = [(-dist[o], number(o), o) for o in l if o and dist[o] > dist[s]]
        if higher:
            edges.append((s, min(higher)[2]))
            plateau[s] = 0
    queue = collections.deque(plateau)
    back = collections.defaultdict(list)
    for s, l in link.items():
        for o in l:
            if o and dist[o] == dist[s]:
                back[o].append(s)
    while queue:
        s = queue.popleft()
        for o in back[s]:
            if o not in plateau:
                plateau[o] = plateau[s] + 1
                queue.append(o)
    for s, l in link.items():
        level = [o for o in l if o and dist[o] == dist[s]]
        if s not in plateau:
            edges += [(s, o) for o in level]
        elif plateau[s]:
            edges.append((s, min((o for o in level if plateau.get(o) == plateau[s] - 1), key=number)))
    return united([number(s) for s in link], [(number(a), number(b)) for a, b in edges])


def ground(seed=5):
    """Spans on both sides of tiles: rising ground with holes, and a bridge over it."""
    rng = random.Random(seed)
    spans = [(x, z, x // 9, 1 << 20) for x in range(96, 160) for z in range(-24, 24) if rng.random() < 0.97]
    over = {(x, z) for x in range(110, 140) for z in range(-6, 6)}
    return [(x, z, t, 14 if (x, z) in over else r) for x, z, t, r in spans] + [(x, z, 30, 1 << 20) for x, z in sorted(over)]


def frame(spark, spans):
    return spark.createDataFrame(spans, "gx int, gz int, top int, room int").repartition(3)


def test_distance_regions_and_polygons(spark):
    spans = ground()
    link = plain_links(spans, 2, 6)
    dist = plain_distance(link)
    field = navfield.border_distance(frame(spark, spans), 2, 6)
    assert {(r.gx, r.gz, r.top): r.dist for r in field.collect()} == dist and max(dist.values()) > 8
    want = plain_watershed(link, dist)
    regions = navfield.watershed(field, 2, 6)
    found = {r.id: r.region for r in regions.collect()}
    assert found == want and 3 < len(set(want.values())) < len(want) / 3
    sides = collections.Counter()
    for s, l in link.items():
        for o in l:
            if o and want[number(o)] != want[number(s)]:
                sides[want[number(s)], want[number(o)]] += 1
                sides[want[number(o)], want[number(s)]] += 1
    assert {(r.a, r.b): r.sides for r in navfield.region_sides(regions, 2, 6).collect()} == sides
    # Merging by rounds.
    size, into = collections.Counter(want.values()), {r: r for r in want.values()}
    while True:
        near = collections.defaultdict(list)
        for (a, b), n in sides.items():
            if size[a] <= 60:
                near[a].append((n, size[b], -b))
        if not near:
            break
        join = united(size, [(a, -max(v)[2]) for a, v in near.items()])
        into = {r: join[o] for r, o in into.items()}
        size = sum((collections.Counter({join[r]: n}) for r, n in size.items()), collections.Counter())
        sides = sum((collections.Counter({(join[a], join[b]): n}) for (a, b), n in sides.items() if join[a] != join[b]), collections.Counter())
    merged = navfield.merge_regions(regions, 2, 6, 20, 60)
    kept = {r.id: r.region for r in merged.collect()}
    assert kept == {n: into[r] for n, r in want.items() if size[into[r]] >= 20}
    # Polygons cover the spans of their region, each cell once, and their corners do not depend on the task.
    for error in (0.0, navpoly.MAX_ERROR):
        rows = navpoly.region_polygons(merged, 2, 6, error).collect()
        area = collections.Counter()
        for r in rows:
            ring = list(zip(r.xs, r.zs, strict=True))
            assert navpoly.ring_area(ring) > 0 and len(ring) <= navpoly.MAX_VERTICES
            assert all(navpoly.cross(ring[k - 1], ring[k], ring[(k + 1) % len(ring)]) >= 0 for k in range(len(ring)))
            area[r.region] += navpoly.ring_area(ring)
        cells = collections.Counter(kept.values())
        assert all(abs(area[r] - n) <= (1e-6 if error == 0 else 1.3 * 4 * n**0.5 + 0.05 * n) for r, n in cells.items())


def covered(polygons, x, z):
    return sum(all(navpoly.cross(p[k], p[(k + 1) % len(p)], (x, z)) > 0 for k in range(len(p))) for p in polygons)


def test_contours_keep_holes_and_touching_corners():
    rng = random.Random(8)
    shapes = [{(x, z) for x in range(w) for z in range(w) if rng.random() < d} for w in (3, 5, 8, 11) for d in (0.4, 0.7, 0.9) for _ in range(12)]
    shapes.append({(x, z) for x in range(9) for z in range(9)} - {(2, 2), (3, 3), (5, 5), (5, 6), (7, 1)})
    for cells in shapes:
        if not cells:
            continue
        a = np.array(sorted(cells), np.int64)
        zero = np.zeros(len(a), np.int64)
        c = {"gx": a[:, 0], "gz": a[:, 1], "top": zero, "room": zero + 100, "region": zero, "tx": zero, "tz": zero}
        rings, piece = navpoly.contours(c, navfield.links(c, 1, 4))
        for p in np.unique(piece):
            own = piece == p
            polygons = [ring for ring, _ in navpoly._piece_polygons([r for r in rings if r.piece == p], a[own, 0], a[own, 1], zero[own], 0.0)]
            inside = set(map(tuple, a[own].tolist()))
            for x in range(-1, 12):
                for z in range(-1, 12):
                    for dx, dz in ((0.3137, 0.1711), (0.7713, 0.8391)):
                        assert covered(polygons, x + dx, z + dz) == ((x, z) in inside)


def test_simplified_contours_fit_together():
    """Both sides of a wavy line between regions get the same corners."""
    a = np.array([(x, z) for x in range(60) for z in range(60)], np.int64)
    zero = np.zeros(len(a), np.int64)
    c = {"gx": a[:, 0], "gz": a[:, 1], "top": zero, "room": zero + 100, "tx": zero, "tz": zero, "region": (a[:, 0] + 3 * np.sin(a[:, 1] / 4) > 30).astype(np.int64)}
    rings, piece = navpoly.contours(c, navfield.links(c, 1, 4))
    one, two = (set(navpoly.simplified(r, 1.3)) for r in rings)
    assert len(rings) == 2 and len(one & two) > 8
    polygons = [ring for r in rings for ring, _ in navpoly._piece_polygons([r], a[piece == r.piece, 0], a[piece == r.piece, 1], zero[piece == r.piece], 1.3)]
    assert abs(sum(map(navpoly.ring_area, polygons)) - 3600) < 1e-6


def test_low_hanging_and_ledges(spark):
    kind = "gx int, gz int, bottom int, top int, walkable boolean"
    column = [(0, 0, 0, 1, True), (0, 0, 2, 3, False), (0, 0, 4, 5, False), (1, 0, 0, 1, False), (1, 0, 5, 9, False)]
    found = navmesh.low_hanging(spark.createDataFrame(column, kind), 2).orderBy("gx", "bottom").collect()
    assert [r.walkable for r in found] == [True, True, False, False, False]  # it isn't handed on from a span that had it handed on
    # A kerb of two on a flat floor can be stepped on; one of three is a ledge on top.
    for rise, good in ((2, True), (3, False)):
        floor = [(x, z, 0, 1 + rise * (x >= 5), True) for x in range(10) for z in range(10)]
        out = navmesh.ledges(navmesh.with_room(spark.createDataFrame(floor, kind)), 2, 8).where("walkable").collect()
        inner = {(r.gx, r.gz) for r in out}
        assert {(x, z) for x in range(1, 9) for z in range(1, 9) if x != 5} <= inner and all(((5, z) in inner) == good for z in range(1, 9))
        assert not any(x in (0, 9) or z in (0, 9) for x, z in inner)


def quads(spark, rects):
    rows = []
    for x0, z0, x1, z1, y in rects:
        rows += [(x0, y, z0, x0, y, z1, x1, y, z1), (x0, y, z0, x1, y, z1, x1, y, z0)]
    return spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(rows)], "tid long, " + ", ".join(f"{c} double" for c in mesh.CORNERS))


def test_rooms_with_a_door_and_merging(spark):
    rooms = quads(spark, [(0, 0, 3, 3, 0), (3, 1, 3.5, 1.8, 0), (3.5, 0, 7, 3, 0)])
    p = navmesh.NavmeshParams()
    field = navmesh.walkable_spans(rooms, p)
    count = lambda p: navmesh.regions(field, p).select("region").distinct().count()
    assert count(p) == 2 and count(navmesh.NavmeshParams(merge_region_size=40)) == 1 and count(navmesh.NavmeshParams(min_region_size=100)) == 0
    out = navmesh.bake_navmesh(rooms, p)
    total, low, high, n = mesh.with_area(out).agg(F.sum("area"), F.min("ay"), F.max("ay"), F.countDistinct("region")).head()
    assert n == 2 and abs(total - field.count() * p.cell**2) < 0.5 and low == high == pytest.approx(0.05)
    assert navmesh.walkable_triangles(out.select("tid", *mesh.CORNERS), 45.0).count() == out.count()


def test_slope_is_followed(spark):
    a, b, c, d = (0.0, 0.0, 0.0), (0.0, 0.0, 6.0), (12.0, 3.0, 6.0), (12.0, 3.0, 0.0)
    slope = spark.createDataFrame([(0, *a, *b, *c), (1, *a, *c, *d)], "tid long, " + ", ".join(f"{k} double" for k in mesh.CORNERS))
    p = navmesh.NavmeshParams()
    out = navmesh.bake_navmesh(slope, p)
    off = max(abs(r[f"{v}y"] - r[f"{v}x"] / 4) for r in out.collect() for v in "abc")
    assert off <= 3 * p.height and out.count() > 1


def test_large_triangle_is_dealt_out(spark):
    big = quads(spark, [(0, 0, 30, 30, 0)])
    p = navmesh.NavmeshParams()
    assert 300 * 300 > navmesh.LARGE and navmesh.spans(big, p).where("gx < 300 AND gz < 300").count() == 90_000

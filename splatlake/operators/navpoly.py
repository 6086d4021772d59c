"""Contours of regions, convex polygons inside them and triangles that follow the spans' heights.

A region is cut at the sides of tiles, so a contour is one task's. Coordinates are corners of cells; a polygon's inside lies to the left of its sides
with x to the right and z up.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splatlake.functions.storage import written
from splatlake.operators.navfield import SPAN, TILE, border_distance, links, merge_regions, number, packed_regions, unpacked, watershed
from splatlake.operators.tiles import roots, whole_tiles

#: Cells that a simplified contour may lie off, vertices of a polygon, cells between height samples, heights that a surface may lie off.
MAX_ERROR, MAX_VERTICES, SAMPLE, HEIGHT_ERROR = 1.3, 6, 6, 1.0
#: Cells that corners are moved by where a contour touches itself.
APART = 1e-4
#: Points of a chain from which on arrays are quicker than numbers.
FEW = 50
#: Vertices of a contour that is cut into triangles without being simplified.
MOST_EXACT = 400
# Corners of a cell at which its sides (in the order of the steps) begin.
_BEGIN = np.array([(1, 0), (1, 1), (0, 1), (0, 0)])
_NOTHING, _TILE_SIDE = -1, -2
SCHEMA = "region long, tx long, tz long, piece long, nth long, xs array<long>, zs array<long>, heights array<double>"
#: Rows of packed spans (and of roots) that are solved at once, at least.
PACKED_ROWS = 1024

Point = tuple[int, int]


def cross(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def ring_area(ring: list) -> float:
    """Signed; positive where the inside is to the left."""
    return sum(p[0] * q[1] - p[1] * q[0] for p, q in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


@dataclass
class Contour:
    """Closed sequence of corners, with what lies on the other side of the side that begins at each."""

    corners: list[Point]
    beyond: list[int]
    piece: int


def contours(c: dict[str, np.ndarray], link: np.ndarray) -> tuple[list[Contour], np.ndarray]:
    """Contours of the connected pieces of regions (in the tiles at hand) and the piece of each span; link is within tiles and both ways."""
    n, at = len(c["gx"]), np.arange(len(c["gx"]))
    region = c["region"]
    same = (link >= 0) & (region[link] == region[:, None])
    i, k = np.nonzero(same)
    piece = roots(i, link[i, k], n)
    side = ~same
    edge = np.full((n, 4), -1, np.int64)
    i, k = np.nonzero(side)
    edge[i, k] = np.arange(len(i))
    # From the end of a side turn round the corner until the next side.
    cell, s = at[i], (k + 1) % 4
    for _ in range(8):
        inner = same[cell, s]
        cell, s = np.where(inner, link[cell, s], cell), np.where(inner, (s - 1) % 4, s)
    after = edge[cell, s]
    x, z = c["gx"][i] + _BEGIN[k, 0], c["gz"][i] + _BEGIN[k, 1]
    at_side = np.stack([c["gx"] % TILE == TILE - 1, c["gz"] % TILE == TILE - 1, c["gx"] % TILE == 0, c["gz"] % TILE == 0], 1)[i, k]
    beyond = np.where(link[i, k] >= 0, region[link[i, k]], np.where(at_side, _TILE_SIDE, _NOTHING))
    out, seen = [], np.zeros(len(i), bool)
    after_, x_, z_, k_, beyond_ = after.tolist(), x.tolist(), z.tolist(), k.tolist(), beyond.tolist()
    for first in range(len(i)):
        if seen[first] or after_[first] < 0:
            continue
        ring, e = [], first
        while not seen[e]:
            seen[e] = True
            ring.append(e)
            e = after_[e]
        # Corners where the direction or what lies beyond changes.
        keep = [e for b, e in zip(ring[-1:] + ring[:-1], ring, strict=True) if k_[b] != k_[e] or beyond_[b] != beyond_[e]]
        out.append(Contour([(x_[e], z_[e]) for e in keep], [beyond_[e] for e in keep], int(piece[i[first]])))
    return out, piece


def _chain(points: list[Point], error: float) -> list[Point]:
    """Points of a chain without its last that keep it within ``error``; the same points in both directions."""
    a, b = points[0], points[-1]
    if len(points) < 3:
        return [a]
    dx, dz = b[0] - a[0], b[1] - a[1]
    length = dx * dx + dz * dz
    if len(points) > FEW:
        x, z = (np.array(points[1:-1]) - a).T
        t = np.clip((x * dx + z * dz) / length, 0, 1) if length else np.zeros(len(x))
        off = ((x - t * dx) ** 2 + (z - t * dz) ** 2).tolist()
    else:
        off = []
        for x, z in points[1:-1]:
            x, z = x - a[0], z - a[1]
            t = min(max((x * dx + z * dz) / length, 0.0), 1.0) if length else 0.0
            off.append((x - t * dx) ** 2 + (z - t * dz) ** 2)
    most = max(off)
    if most <= error * error:
        return [a]
    worst = min((points[k], k) for k, v in enumerate(off, 1) if v >= most - 1e-9)[1]
    return _chain(points[: worst + 1], error) + _chain(points[worst:], error)


def simplified(contour: Contour, error: float) -> list[Point]:
    """Corners where the other side changes, and between these as many as keep the contour within ``error``.

    Contours on both sides of a line between regions get the same corners.
    """
    points, n = contour.corners, len(contour.corners)
    fixed = [k for k in range(n) if contour.beyond[k - 1] != contour.beyond[k]]
    if len(fixed) < 2:
        fixed = sorted({points.index(min(points)), points.index(max(points))} | set(fixed))
    out = []
    for a, b in zip(fixed, fixed[1:] + [fixed[0] + n], strict=True):
        out += _chain([points[k % n] for k in range(a, b + 1)], error)
    return out


def _crossing(rings: list[list[Point]]) -> bool:
    """Whether sides of rings cross or touch other than at common corners."""
    a = np.array([p for r in rings for p in r])
    b = np.array([p for r in rings for p in r[1:] + r[:1]])
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.argsort(low[:, 0], kind="stable")
    a, b, low, high = a[order], b[order], low[order], high[order]
    # Only sides whose boxes meet.
    counts = np.searchsorted(low[:, 0], high[:, 0], "right") - np.arange(1, len(a) + 1)
    i = np.repeat(np.arange(len(a)), counts)
    j = np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts) + i + 1
    near = (low[i, 1] <= high[j, 1]) & (low[j, 1] <= high[i, 1])
    i, j = i[near], j[near]
    o, p, u, v = a[i], b[i], a[j], b[j]
    turn = lambda o, p, q: (p[:, 0] - o[:, 0]) * (q[:, 1] - o[:, 1]) - (p[:, 1] - o[:, 1]) * (q[:, 0] - o[:, 0])
    s1, s2, s3, s4 = turn(o, p, u), turn(o, p, v), turn(u, v, o), turn(u, v, p)
    if ((np.sign(s1) * np.sign(s2) < 0) & (np.sign(s3) * np.sign(s4) < 0)).any():
        return True
    within = lambda s, q, o, p: ((s == 0) & (((q - o) * (q - p)).sum(1) < 0)).any()  # noqa: E731 between the ends
    return bool(within(s1, u, o, p) or within(s2, v, o, p) or within(s3, o, u, v) or within(s4, p, u, v))


def _bridged(outer: list[Point], holes: list[list[Point]]) -> list[Point] | None:
    """One ring of a ring and the holes in it, joined by sides that are gone along twice."""
    ring = outer
    holes = sorted(holes, key=max, reverse=True)
    for nth, hole in enumerate(holes):
        from_, others = max(hole), [ring, *holes[nth:]]
        for k in sorted(range(len(ring)), key=lambda k: ((ring[k][0] - from_[0]) ** 2 + (ring[k][1] - from_[1]) ** 2, k)):
            to = ring[k]
            if not _inward(ring, k, from_) or any(_meets(to, from_, u, v) for r in others for u, v in zip(r, r[1:] + r[:1], strict=True)):
                continue
            start = next((j for j, v in enumerate(hole) if v == from_ and _inward(hole, j, to)), None)
            if start is not None:
                ring = ring[: k + 1] + hole[start:] + hole[: start + 1] + ring[k:]
                break
        else:
            return None
    return ring


def _inward(ring: list[Point], k: int, to: Point) -> bool:
    """Whether the way from a ring's corner to a point begins on the ring's inside."""
    p, v, q = ring[k - 1], ring[k], ring[(k + 1) % len(ring)]
    if to in (p, v, q):
        return False
    left, right = cross(p, v, to) > 0, cross(v, q, to) > 0
    return left and right if cross(p, v, q) > 0 else left or right


def _meets(a: Point, b: Point, u: Point, v: Point) -> bool:
    """Whether side (u, v) meets (a, b) other than in its ends a and b."""
    s1, s2, s3, s4 = cross(a, b, u), cross(a, b, v), cross(u, v, a), cross(u, v, b)
    if s1 * s2 < 0 and s3 * s4 < 0:
        return True
    on = lambda s, q, c, d: s == 0 and q not in (c, d) and (q[0] - c[0]) * (q[0] - d[0]) + (q[1] - c[1]) * (q[1] - d[1]) < 0
    return on(s1, u, a, b) or on(s2, v, a, b) or on(s3, a, u, v) or on(s4, b, u, v)


def _apart(ring: list[Point]) -> list[tuple[float, float]]:
    """The ring with corners that it passes more than once moved a little to its inside, so that it no longer touches itself."""
    counts: dict[Point, int] = {}
    for p in ring:
        counts[p] = counts.get(p, 0) + 1
    out = []
    for k, b in enumerate(ring):
        if counts[b] == 1:
            out.append(b)
            continue
        a, c = ring[k - 1], ring[(k + 1) % len(ring)]
        u, v = math.hypot(a[0] - b[0], a[1] - b[1]), math.hypot(c[0] - b[0], c[1] - b[1])
        u, v = ((a[0] - b[0]) / u, (a[1] - b[1]) / u), ((c[0] - b[0]) / v, (c[1] - b[1]) / v)
        # Half way between the sides, or to the left of what is nearly a line; a corner of no angle is a way back.
        x, z = u[0] + v[0], u[1] + v[1]
        turn, along = cross(a, b, c), u[0] * v[0] + u[1] * v[1]
        if turn == 0:
            x, z = (-v[1], v[0]) if along < 0 else (-v[0], -v[1])
        elif turn < 0:
            x, z = -x, -z
        length = math.hypot(x, z)
        out.append((b[0] + x / length * APART, b[1] + z / length * APART))
    return out


def _within(a, b, c, places: list, which: list[int], but: tuple[int, int, int]) -> bool:
    """Whether any of the places is in a triangle or on its sides."""
    (ax, az), (bx, bz), (cx, cz) = a, b, c
    abx, abz, bcx, bcz, cax, caz = bx - ax, bz - az, cx - bx, cz - bz, ax - cx, az - cz
    for q in which:
        x, z = places[q]
        if abx * (z - az) - abz * (x - ax) >= 0 and bcx * (z - bz) - bcz * (x - bx) >= 0 and cax * (z - cz) - caz * (x - cx) >= 0 and q not in but:
            return True
    return False


def ears(ring: list[Point]) -> list[tuple[Point, Point, Point]] | None:
    """Triangles of a ring that may touch itself, by cutting off ears; None if it can't be done."""
    at_, left, out = _apart(ring), list(range(len(ring))), []
    at = stuck = 0
    while len(left) > 2:
        n = len(left)
        i, j, k = left[at % n - 1], left[at % n], left[(at + 1) % n]
        a, b, c = at_[i], at_[j], at_[k]
        if cross(a, b, c) > 0 and not _within(a, b, c, at_, left, (i, j, k)):
            turn = cross(ring[i], ring[j], ring[k])
            if turn < 0:
                return None
            if turn:
                out.append((ring[i], ring[j], ring[k]))
            del left[at % n]
            at, stuck = at % n, 0
            continue
        at, stuck = at + 1, stuck + 1
        if stuck > n:
            return None
    return out


def convex_polygons(triangles: list[tuple[Point, Point, Point]], most: int = MAX_VERTICES) -> list[list[Point]]:
    """Triangles merged over common sides into convex polygons of at most ``most`` corners, the longest sides first."""
    polygons = {k: list(t) for k, t in enumerate(triangles)}
    of: dict[tuple[Point, Point], int] = {}
    for k, t in polygons.items():
        for j in range(3):
            of[t[j], t[(j + 1) % 3]] = k
    shared = sorted((s for s in of if s[0] < s[1] and s[::-1] in of), key=lambda s: (-((s[0][0] - s[1][0]) ** 2 + (s[0][1] - s[1][1]) ** 2), s))
    for a, b in shared:
        one, two = of[a, b], of[b, a]
        p, q = polygons[one], polygons[two]
        if one == two or len(p) + len(q) - 2 > most:
            continue
        i, j = p.index(b), q.index(a)
        p, q = p[i:] + p[:i], q[j:] + q[:j]  # b .. a and a .. b
        ring = p + q[1:-1]
        n = len(ring)
        # Of the corners only b and a are new.
        if len(set(ring)) < n or cross(ring[-1], b, ring[1]) < 0 or cross(p[-2], a, ring[len(p) % n]) < 0:
            continue
        polygons[one] = ring
        del polygons[two]
        for k in range(n):
            of[ring[k], ring[(k + 1) % n]] = one
    return list(polygons.values())


def _rectangles(x: np.ndarray, z: np.ndarray, top: np.ndarray) -> list[tuple[list[Point], list[float]]]:
    """Runs of cells of one height, as flat polygons."""
    order = np.lexsort((x, top, z))
    x, z, top = x[order], z[order], top[order]
    new = np.ones(len(x), bool)
    new[1:] = (z[1:] != z[:-1]) | (top[1:] != top[:-1]) | (x[1:] != x[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(x)) - 1
    return [([(a, b), (e + 1, b), (e + 1, b + 1), (a, b + 1)], [h] * 4) for a, e, b, h in zip(x[first].tolist(), x[last].tolist(), z[first].tolist(), top[first].tolist(), strict=True)]


def _piece_polygons(rings: list[Contour], x, z, top, error: float) -> list[tuple[list[Point], list[float]]]:
    """Polygons of one piece with heights of their corners: of simplified contours, else of exact ones, else rectangles."""
    flat = (x.astype(np.int64) << 32) + z
    if len(np.unique(flat)) == len(flat):
        tops = dict(zip(zip(x.tolist(), z.tolist(), strict=True), top.tolist(), strict=True))
        # The highest of the cells that meet in a corner.
        height = lambda v: max([t for c in ((v[0], v[1]), (v[0] - 1, v[1]), (v[0], v[1] - 1), (v[0] - 1, v[1] - 1)) if (t := tops.get(c)) is not None])
        for limit in (error, 0.0):
            own = [simplified(r, limit) if limit else r.corners for r in rings]
            if sum(map(len, own)) > MOST_EXACT and not limit:
                break
            own = [r for r in own if len(r) > 2 and ring_area(r)]
            outer = [r for r in own if ring_area(r) > 0]
            if len(outer) != 1 or (limit and _crossing(own)):
                continue
            ring = _bridged(outer[0], [r for r in own if ring_area(r) < 0])
            triangles = ears(ring) if ring else None
            if triangles and abs(sum(cross(*t) for t in triangles) / 2 - sum(map(ring_area, own))) < 1e-6:
                return [(p, [height(v) for v in p]) for p in convex_polygons(triangles)]
    return _rectangles(x, z, top)


def _detailed(polygon: list[Point], heights: list[float], samples: np.ndarray) -> list[list[tuple[float, float, float]]]:
    """Triangles (x, height, z) of a polygon, cut at samples (x, z, height) until these lie within ``HEIGHT_ERROR`` of them."""
    corners = [(float(a), float(h), float(b)) for (a, b), h in zip(polygon, heights, strict=True)]
    todo = [[corners[0], corners[k], corners[k + 1]] for k in range(1, len(corners) - 1)]
    out = []
    while todo:
        t = todo.pop()
        a, b, c = (np.array((v[0], v[2])) for v in t)
        area = cross(a, b, c)
        if area <= 0:
            continue  # three corners in a line
        near = samples
        if len(near):
            p = near[:, :2]
            u = ((b[0] - p[:, 0]) * (c[1] - p[:, 1]) - (b[1] - p[:, 1]) * (c[0] - p[:, 0])) / area
            v = ((c[0] - p[:, 0]) * (a[1] - p[:, 1]) - (c[1] - p[:, 1]) * (a[0] - p[:, 0])) / area
            w = 1 - u - v
            off = np.abs(u * t[0][1] + v * t[1][1] + w * t[2][1] - near[:, 2])
            off[np.minimum(np.minimum(u, v), w) < 1e-3] = 0
            k = int(off.argmax())
            if off[k] > HEIGHT_ERROR:
                q = (float(near[k, 0]), float(near[k, 2]), float(near[k, 1]))
                todo += [[t[0], t[1], q], [t[1], t[2], q], [t[2], t[0], q]]
                continue
        out.append(t)
    return out


def region_polygons(spans: DataFrame, climb: int, tall: int, error: float = MAX_ERROR) -> DataFrame:
    """Convex polygons of regions: region, tx, tz, piece, nth, xs, zs (corners of cells), heights, and triangles (x, height, z of three corners each, flat)."""
    rows = spans.withColumns({"tx": F.floor(F.col("gx") / TILE).cast("int"), "tz": F.floor(F.col("gz") / TILE).cast("int")})
    return whole_tiles(rows, ["tx", "tz"], lambda c: _tile_polygons(c, climb, tall, error), f"{SCHEMA}, triangles array<double>")


def merged_polygons(spans: DataFrame, climb: int, tall: int, least: int, merge: int, error: float = MAX_ERROR) -> DataFrame:
    """Polygons (``region_polygons``, without triangles) of the merged regions of spans."""
    packed = packed_regions(spans, climb, tall, least, merge)
    if packed is None:
        found = written(watershed(border_distance(spans, climb, tall), climb, tall), "regions")
        return region_polygons(merge_regions(found, climb, tall, least, merge), climb, tall, error).drop("triangles")

    def kernel(c: dict[str, np.ndarray]) -> dict[str, list]:
        named = np.flatnonzero(c["spans"] == b"")
        named = named[np.argsort(c["root"][named])]
        s = unpacked(c["spans"])
        at = np.searchsorted(c["root"][named], s["root"])
        s, at = s[at < len(named)], at[at < len(named)]
        good = c["root"][named][at] == s["root"]
        s, at = s[good], at[good]
        s_ = {k: np.ascontiguousarray(s[k]) for k in SPAN}
        return _tile_polygons(s_ | {"tx": s_["gx"] // TILE, "tz": s_["gz"] // TILE, "id": number(*[s_[k] for k in ("gx", "gz", "top")]), "region": c["region"][named][at]}, climb, tall, error, detail=False)

    return whole_tiles(packed, ["tx", "tz"], kernel, SCHEMA, PACKED_ROWS)


def _tile_polygons(c: dict[str, np.ndarray], climb: int, tall: int, error: float, detail: bool = True) -> dict[str, list]:
    """Polygons of whole tiles, with triangles if ``detail``."""
    rows: dict[str, list] = {k: [] for k in ("region", "tx", "tz", "piece", "nth", "xs", "zs", "heights", "triangles")[: 9 if detail else 8]}
    if not len(c["gx"]):
        return rows
    # In order of places, as where a contour begins decides on how it is cut into triangles.
    order = np.lexsort([c[k] for k in ("top", "gx", "gz", "tx", "tz")])
    c = {k: v[order] for k, v in c.items()}
    link = links(c, climb, tall)
    back = np.full_like(link, -1)
    for k in range(4):
        i = np.flatnonzero(link[:, k] >= 0)
        j = link[i, k]
        good = i[link[j, (k + 2) % 4] == i]
        back[good, k] = link[good, k]
    rings, piece = contours(c, back)
    by_piece: dict[int, list[Contour]] = {}
    for r in rings:
        by_piece.setdefault(r.piece, []).append(r)
    order = np.argsort(piece, kind="stable")
    first = np.flatnonzero(np.append(True, piece[order][1:] != piece[order][:-1]))
    ids = c["id"]
    for group in np.split(order, first[1:]):
        x, z, top = (c[k][group].astype(np.int64) for k in ("gx", "gz", "top"))
        at = group[0]
        polygons = _piece_polygons(by_piece.get(int(piece[at]), []), x, z, top, error)
        for k, v in zip(("region", "tx", "tz", "piece"), (c["region"][at], c["tx"][at], c["tz"][at], ids[group].min()), strict=True):
            rows[k] += [int(v)] * len(polygons)
        rows["nth"] += range(len(polygons))
        rows["xs"] += [[v[0] for v in polygon] for polygon, _ in polygons]
        rows["zs"] += [[v[1] for v in polygon] for polygon, _ in polygons]
        rows["heights"] += [[float(h) for h in heights] for _, heights in polygons]
        if not detail:
            continue
        sampled = (x % SAMPLE == 0) & (z % SAMPLE == 0)
        samples = np.stack([x[sampled] + 0.5, z[sampled] + 0.5, top[sampled]], 1).astype(float)
        for polygon, heights in polygons:
            (a, b), (d, e) = np.min(polygon, 0), np.max(polygon, 0)
            inside = samples[(samples[:, 0] > a) & (samples[:, 0] < d) & (samples[:, 1] > b) & (samples[:, 1] < e)]
            rows["triangles"].append([v for t in _detailed(polygon, heights, inside) for p in t for v in p])
    return rows

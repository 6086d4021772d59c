"""Fields over walkable spans: links, distances to the border, watershed regions.

A span is (gx, gz, top, room): its column, the height of its surface and the free height above it, in cells. Columns are cut into square tiles;
a tile's task also sees the ring of columns around it. What runs further than a tile (distances, plateaus) is repeated with the ring's
new values until nothing changes at the sides of tiles, and regions of several tiles are joined by connected components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from splatlake.functions.storage import discard, written
from splatlake.operators.components import connected_components, of_one_task
from splatlake.operators.tiles import places, roots, whole_tiles
from splatlake.operators.voxel import ONE_TASK_EDGES

#: Columns of a tile's side.
TILE = 128
#: Columns of the ring in which what runs further than a tile is followed at once.
RING = 8
#: Steps to the four neighbours, in a ring.
STEPS = [(1, 0), (0, 1), (-1, 0), (0, -1)]
#: Length of a step and of two steps round a corner.
STRAIGHT, DIAGONAL = 2, 3
FAR = 1 << 30
_BITS = 21
SPAN = ["gx", "gz", "top", "room"]
#: Columns of the ring in which a tile's regions are found at once, and of the wider one for the tiles that need more.
WIDE, WIDEST = 2 * RING, TILE - 1
#: Packed rows up to which tiles get the widest ring even if they are most of them.
FEW_OPEN = 1000
#: A span as it is written in packed rows, and spans of such a row.
PACKED = np.dtype([("gx", "<i4"), ("gz", "<i4"), ("top", "<i4"), ("room", "<i4"), ("root", "<i8")])
PACK = 128


def span_id() -> Column:
    """gx, gz and top as one number; gz and top within a million of zero, gx up to three million above (numbers are negative from a million on)."""
    half = 1 << _BITS - 1
    part = lambda c: F.col(c).cast("long") + half
    return F.shiftleft(F.shiftleft(part("gx"), _BITS) + part("gz"), _BITS) + part("top")


def number(gx: np.ndarray, gz: np.ndarray, top: np.ndarray) -> np.ndarray:
    """``span_id`` of arrays."""
    half = 1 << _BITS - 1
    return ((gx.astype(np.int64) + half << _BITS) + (gz.astype(np.int64) + half) << _BITS) + (top.astype(np.int64) + half)


def _tile_of(c: str) -> list[Column]:
    """Tile (tx, tz) of a ``span_id``."""
    half = 1 << _BITS - 1
    return [F.floor((v - half) / TILE).cast("int") for v in (F.shiftrightunsigned(c, 2 * _BITS), F.shiftrightunsigned(c, _BITS).bitwiseAND((1 << _BITS) - 1))]


def located(ids: np.ndarray) -> dict[str, np.ndarray]:
    """gx, gz and top of ``span_id``."""
    half, mask = 1 << _BITS - 1, (1 << _BITS) - 1
    return {"gx": (ids.view(np.uint64) >> np.uint64(2 * _BITS)).astype(np.int64) - half, "gz": (ids >> _BITS & mask) - half, "top": (ids & mask) - half}


def in_tiles(spans: DataFrame, ring: int = 1) -> DataFrame:
    """Spans with the tile (tx, tz) that they lie in (own) and once more for each tile whose ring of ``ring`` columns (less than a tile) they lie in."""
    tile = lambda c: F.floor(F.col(c) / TILE).cast("int")
    near = lambda c: F.sequence(F.floor((F.col(c) - ring) / TILE).cast("int"), F.floor((F.col(c) + ring) / TILE).cast("int"))
    out = spans.withColumn("tx", F.explode(near("gx"))).withColumn("tz", F.explode(near("gz")))
    return out.withColumn("own", (F.col("tx") == tile("gx")) & (F.col("tz") == tile("gz")))


def links(c: dict[str, np.ndarray], climb: int, tall: int, ring: int = RING) -> np.ndarray:
    """For each span and step the place of the span that one can walk to, or -1: within ``climb``, with ``tall`` free above both; the nearest in height, ties to the lower."""
    n = len(c["gx"])
    tile = places(c["tx"], c["tz"])
    wide = TILE + 2 * ring + 2
    column = (tile * wide + (c["gz"] - c["tz"].astype(np.int64) * TILE + ring + 1)) * wide + (c["gx"] - c["tx"].astype(np.int64) * TILE + ring + 1)
    top, room = c["top"].astype(np.int64), c["room"].astype(np.int64)
    low = int(top.min(initial=0)) - climb - 1
    height = int(top.max(initial=0)) + climb + 2 - low
    order = np.argsort(column * height + (top - low))
    key = (column * height + (top - low))[order]
    out = np.full((n, 4), -1, np.int64)
    for k, (dx, dz) in enumerate(STEPS):
        other = column + dz * wide + dx
        at = np.searchsorted(key, other * height + (top - low))
        best = np.full(n, FAR)
        for place in (at - 1, at):
            inside = (place >= 0) & (place < n)
            j = order[np.clip(place, 0, n - 1)]
            step = np.abs(top[j] - top)
            free = np.minimum(top + room, top[j] + room[j]) - np.maximum(top, top[j])
            good = inside & (column[j] == other) & (step <= climb) & (free >= tall) & (step < best)
            out[good, k], best[good] = j[good], step[good]
    return out


def _shortest(start: np.ndarray, link: np.ndarray, own: np.ndarray, corners: bool, along: np.ndarray | None = None, most: int = FAR) -> np.ndarray:
    """Shortest ways from the values at hand; ``along`` says which links may be gone. Ways that are longer than ``most`` may come out too long."""
    value = start.copy()
    ways = []
    for k in range(4):
        i = np.flatnonzero(own & (link[:, k] >= 0) & (True if along is None else along[:, k]))
        j = link[i, k]
        ways.append((i, j, STRAIGHT if corners else 1))
        if corners:
            for turn in (k + 1, k + 3):
                m = link[j, turn % 4]
                ways.append((i[m >= 0], m[m >= 0], DIAGONAL))
    for _ in range(most // (STRAIGHT if corners else 1) + 1):
        before = value.copy()
        for i, j, length in ways:
            value[i] = np.minimum(value[i], value[j] + length)
        if np.array_equal(before, value):
            break
    return value


def known(c: dict[str, np.ndarray], ring: int = RING) -> np.ndarray:
    """Spans of which all neighbours are at hand: all but those of the ring's last columns."""
    off = [c[f"g{k}"] - c[f"t{k}"].astype(np.int64) * TILE for k in "xz"]
    return np.logical_and.reduce([(v > -ring) & (v < TILE + ring - 1) for v in off])


def _settled(spans: DataFrame, name: str, kernel: Callable, rounds: int = 1000) -> DataFrame:
    """``kernel`` in all tiles, again and again until ``name`` no longer changes where other tiles see it. It gets the spans with rings and the last values.

    It returns the new values and which of them hold whatever lies beyond the ring; if all do, the first round is the last.
    """
    names = list(spans.columns)
    keep = [*names, name]
    kinds = dict(spans.dtypes)
    schema = ", ".join(f"{c} {kinds.get(c, 'int')}" for c in keep)

    def run(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        own = c["own"]
        new, sure = kernel(c)
        # Only spans near a side beyond which there is a tile are seen by others.
        edge = np.logical_or.reduce([(c[k] % TILE < RING) | (c[k] % TILE >= TILE - RING) for k in ("gx", "gz")])
        tile = places(c["tx"], c["tz"])
        edge &= (np.bincount(tile, ~own) > 0)[tile]
        return {k: c[k][own] for k in names} | {name: new[own].astype(np.int32), "moved": ((new != c[name]) & edge)[own], "open": ~sure[own]}

    now = spans.withColumn(name, F.lit(FAR))
    last = None
    for _ in range(rounds):
        moved = Observation()
        out = whole_tiles(in_tiles(now, RING), ["tx", "tz"], run, schema + ", moved boolean, open boolean")
        now = written(out.observe(moved, F.count_if("moved").alias("n"), F.count_if("open").alias("open")).select(*keep), name)
        first = last is None
        if last is not None:
            discard(last)
        last = now
        if not moved.get["n"] or (first and not moved.get["open"]):
            return now
    raise RuntimeError(f"{name} has not settled after {rounds} rounds")


def border_distance(spans: DataFrame, climb: int, tall: int) -> DataFrame:
    """Spans with ``dist``, the length of the shortest way to a span that lacks a neighbour (2 for a step, 3 for two round a corner)."""

    def kernel(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        link, inner = links(c, climb, tall), known(c)
        border = inner & (link < 0).any(1)
        out = _shortest(np.where(border, 0, c["dist"]).astype(np.int64), link, inner, True)
        # A way to the ring's last columns has that many steps at least.
        return out, out <= STRAIGHT * RING

    return _settled(spans.select(*SPAN), "dist", kernel)


def _rising(c: dict[str, np.ndarray], link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where spans (with dist and id) drain to, or -1, and which links are level."""
    dist = c["dist"]
    far = np.where(link >= 0, dist[link], -1)
    up = np.full(len(dist), -1, np.int64)
    best = dist.astype(np.int64).copy()
    chosen = np.full(len(dist), np.iinfo(np.int64).max)
    for k in range(4):
        ids = np.where(link[:, k] >= 0, c["id"][link[:, k]], np.iinfo(np.int64).max)
        better = (far[:, k] > best) | ((far[:, k] == best) & (best > dist) & (ids < chosen))
        up[better], best[better], chosen[better] = link[better, k], far[better, k], ids[better]
    return up, far == dist[:, None]


def _drained(c: dict[str, np.ndarray], link: np.ndarray, up: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ways (from, to) of own spans (with steps and id) and for each span the smallest id that ways inside the tile join it with."""
    own, at = c["own"], np.arange(len(c["gx"]))
    step, ids = c["steps"].astype(np.int64), c["id"]
    inner = own & (up < 0) & (step < FAR)
    target, chosen = up.copy(), np.full(len(at), np.iinfo(np.int64).max)
    flat = []
    for k in range(4):
        j = link[:, k]
        good = inner & level[:, k] & (j >= 0) & (step[j] == step - 1) & (ids[j] < chosen)
        target[good], chosen[good] = j[good], ids[j[good]]
        basin = own & (up < 0) & (step >= FAR) & level[:, k] & (j >= 0)
        flat.append((at[basin], j[basin]))
    go = own & (target >= 0)
    flat.append((at[go], target[go]))
    a, b = (np.concatenate(v) for v in zip(*flat, strict=True))
    inside = own[b]
    by_id = np.argsort(ids, kind="stable")
    nth = np.empty_like(by_id)
    nth[by_id] = at
    return a, b, ids[by_id][roots(nth[a[inside]], nth[b[inside]], len(at))][nth]


def watershed(field: DataFrame, climb: int, tall: int) -> DataFrame:
    """Spans (with dist) with ``region``: where water that runs towards greater distances comes together; the smallest id of a span in it.

    A span drains to its neighbour with the greatest distance if that is more than its own (ties: the smallest id). Inside a plateau of
    equal distance spans drain by the fewest steps to one that drains out of it; a plateau without such a span is a basin.
    """

    def steps(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        link, inner = links(c, climb, tall), known(c)
        up, level = _rising(c, link)
        out = _shortest(np.where(inner & (up >= 0), 0, c["steps"]).astype(np.int64), link, inner, False, level)
        # It holds unless the plateau's way to the ring's last columns is shorter.
        return out, out <= _shortest(np.where(inner, FAR, 0).astype(np.int64), link, inner, False, level)

    def drained(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        link, own, ids = links(c, climb, tall), c["own"], c["id"]
        a, b, found = _drained(c, link, *_rising(c, link))
        # A row for each span, and one more for each way to a span of another tile.
        x, y = a[~own[b]], b[~own[b]]
        mine = np.flatnonzero(own)
        rows = np.concatenate([mine, x])
        return {k: c[k][rows] for k in (*SPAN, "dist", "id")} | {"root": found[rows], "across": np.concatenate([np.full(len(mine), -1), ids[y]]), "way": np.arange(len(rows)) >= len(mine)}

    field = field.withColumn("id", span_id())
    levels = _settled(field, "steps", steps)
    schema = "gx int, gz int, top int, room int, dist int, id long, root long, across long, way boolean"
    parts = written(whole_tiles(in_tiles(levels), ["tx", "tz"], drained, schema), "basins")
    discard(levels)
    spans = parts.where("NOT way").drop("across", "way")
    beyond = spans.select(F.col("id").alias("across"), F.col("root").alias("b"))
    edges = parts.where("way").select(F.col("root").alias("a"), "across").join(beyond, "across").select("a", "b")
    found = connected_components(edges, one_task=ONE_TASK_EDGES)
    return spans.join(found, spans["root"] == found["node"], "left").select(*SPAN, "dist", "id", F.coalesce("component", "root").alias("region"))


def region_sides(spans: DataFrame, climb: int, tall: int) -> DataFrame:
    """Region adjacency graph: (a, b, sides) for regions whose spans are linked, in both directions."""

    def kernel(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        link = links(c, climb, tall)
        i, k = np.nonzero((link >= 0) & c["own"][:, None])
        a, b = c["region"][i], c["region"][link[i, k]]
        a, b = np.concatenate([a, b])[np.tile(a != b, 2)], np.concatenate([b, a])[np.tile(a != b, 2)]
        pairs, counts = np.unique(np.stack([a, b], 1), axis=0, return_counts=True)
        return {"a": pairs[:, 0], "b": pairs[:, 1], "sides": counts.astype(np.int64)}

    rows = in_tiles(spans.select(*SPAN, "region"))
    return whole_tiles(rows, ["tx", "tz"], kernel, "a long, b long, sides long").groupBy("a", "b").agg(F.sum("sides").alias("sides"))


def merge_regions(spans: DataFrame, climb: int, tall: int, least: int, merge: int) -> DataFrame:
    """Spans with the region that theirs was merged into (``merged``); a region of under ``least`` spans is left out at the end."""
    sizes = written(spans.groupBy("region").agg(F.count(F.lit(1)).alias("n")), "regions")
    graph = written(region_sides(spans, climb, tall), "sides")
    return spans.join(merged(sizes, graph, least, merge), "region").drop("region").withColumnRenamed("new", "region")


def _united(edges: DataFrame) -> DataFrame:
    """``connected_components`` of edges (a, b) between ids, without loops; if there are many, what lies inside a tile is united by the tile's task."""

    def kernel(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        a, b, inside = c["a"], c["b"], c["inside"]
        nodes, at = np.unique(np.concatenate([a, b[inside]]), return_inverse=True)
        root = nodes[roots(at[: len(a)][inside], at[len(a) :], len(nodes))]
        # A row for each node, and one more for each way to another tile.
        out = {"node": np.concatenate([nodes, root[at[: len(a)]][~inside]]), "root": np.concatenate([root, b[~inside]])}
        return out | {"way": np.arange(len(out["node"])) >= len(nodes)}

    seen = Observation()
    edges = written(edges.select("a", "b").observe(seen, F.count(F.lit(1)).alias("n")), "edges")
    if seen.get["n"] <= ONE_TASK_EDGES:
        return of_one_task(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    tile = lambda c: F.array(*_tile_of(c))
    rows = edges.select("a", "b", *[v.alias(k) for k, v in zip(("tx", "tz"), _tile_of("a"), strict=True)], (tile("a") == tile("b")).alias("inside"))
    parts = written(whole_tiles(rows, ["tx", "tz"], kernel, "node long, root long, way boolean"), "united")
    nodes = parts.where("NOT way").select("node", "root")
    ways = parts.where("way").select(F.col("node").alias("a"), F.col("root").alias("b"))
    ways = ways.join(nodes.withColumnRenamed("node", "b"), "b", "left").select("a", F.coalesce("root", "b").alias("b"))
    found = written(connected_components(ways, one_task=ONE_TASK_EDGES), "components")
    # Nodes that have ways from other tiles only are not among the tiles'.
    others = found.join(nodes, "node", "left_anti").select("node", "component")
    return nodes.join(found.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("component", "root").alias("component")).union(others)


def merged(sizes: DataFrame, graph: DataFrame, least: int, merge: int, rounds: int = 40) -> DataFrame:
    """For regions of sizes (region, n) and graph (a, b, sides; in both directions) the region ``new`` that each was merged into, if it has ``least`` spans.

    In each round every region of at most ``merge`` spans joins the neighbour that it shares most sides with (ties: the larger
    one, then the smaller id); rounds end when none is left that has a neighbour. The region keeps its smallest id.
    """
    into = sizes.select("region", F.col("region").alias("new"))
    for _ in range(rounds):
        small = graph.join(sizes.where(F.col("n") <= merge).select(F.col("region").alias("a")), "a")
        if not small.take(1):
            break
        other = sizes.select(F.col("region").alias("b"), "n")
        edges = small.join(other, "b").groupBy("a").agg(F.max_by("b", F.struct("sides", "n", -F.col("b"))).alias("b"))
        found = written(_united(edges), "merged")
        moved = lambda df, c: df.join(found.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("component", c)).drop("component")
        into = written(moved(into, "new"), "into")
        sizes = written(moved(sizes, "region").groupBy("region").agg(F.sum("n").alias("n")), "regions")
        graph = written(moved(moved(graph, "a"), "b").where("a <> b").groupBy("a", "b").agg(F.sum("sides").alias("sides")), "sides")
    return into.join(sizes.where(F.col("n") >= least).select(F.col("region").alias("new")), "new").select("region", "new")


# What rows of ``_at_once`` are: spans of a tile that is sure or is not, a way (a root, b a span of another tile), a link (alike), a root of a span at a
# tile's side (a span, b root), n links between two roots, a root of n spans.
_SURE, _OPEN, _WAY, _ACROSS, _SIDE, _PAIR, _SIZE = range(7)


def _basins(c: dict[str, np.ndarray], climb: int, tall: int, ring: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distances and watershed of whole tiles by one look at them and their rings: links, ways (from and to) of own spans, the root
    of each span, and which own spans are not sure by what is at hand."""
    link, inner = links(c, climb, tall, ring), known(c, ring)
    dist = _shortest(np.where(inner & (link < 0).any(1), 0, FAR), link, inner, True)
    # A distance holds unless the way to the ring's last columns is shorter.
    sure = inner & (dist <= _shortest(np.where(inner, FAR, 0), link, inner, True, most=int(dist.max(initial=0, where=inner))))
    c = c | {"dist": dist}
    up, level = _rising(c, link)
    fine = sure & ((link < 0) | sure[link]).all(1)
    steps = _shortest(np.where(fine & (up >= 0), 0, FAR), link, fine, False, level)
    # Steps hold unless a plateau's way to where the distances may not is shorter.
    sure = fine & (steps <= _shortest(np.where(fine, FAR, 0), link, fine, False, level))
    a, b, root = _drained(c | {"steps": steps}, link, up, level)
    return link, a, b, root, c["own"] & ~(sure & ((link < 0) | ~level | sure[link]).all(1))


def _packed(c: dict[str, np.ndarray], root: np.ndarray, rows: np.ndarray) -> tuple[list[int], list[int], list[bytes]]:
    """Tiles (tx, tz) and bytes of at most ``PACK`` spans of a tile each, in order of their places."""
    rows = rows[np.lexsort([c[k][rows] for k in ("top", "gx", "gz", "tx", "tz")])]
    out = np.empty(len(rows), PACKED)
    for k in SPAN:
        out[k] = c[k][rows]
    out["root"] = root[rows]
    tile = places(c["tz"][rows], c["tx"][rows])
    begins = np.flatnonzero(np.diff(tile, prepend=-1))
    ends = np.append(begins, len(rows))[1:]
    cuts = [(k, min(k + PACK, e)) for b, e in zip(begins.tolist(), ends.tolist(), strict=True) for k in range(b, e, PACK)]
    first = rows[[b for b, _ in cuts]] if cuts else rows[:0]
    return c["tx"][first].tolist(), c["tz"][first].tolist(), [out[b:e].tobytes() for b, e in cuts]


def unpacked(packed: np.ndarray) -> np.ndarray:
    """Spans of packed rows."""
    return np.frombuffer(b"".join(packed.tolist()), PACKED)


def _at_once(rows: DataFrame, climb: int, tall: int, ring: int) -> DataFrame:
    """Tiles' spans and graphs of their basins, of spans in tiles with rings: kind, tx, tz, spans, a, b, n."""

    def kernel(c: dict[str, np.ndarray]) -> dict[str, list | np.ndarray]:
        c |= located(c["id"])
        c["own"] = (c["gx"] // TILE == c["tx"]) & (c["gz"] // TILE == c["tz"])
        link, a, b, root, unsure = _basins(c, climb, tall, ring)
        own, ids, tile = c["own"], c["id"], places(c["tx"], c["tz"])
        open_ = (np.bincount(tile, unsure) > 0)[tile]
        mine = own & ~open_
        out: list[tuple] = []
        for kind, which in ((_SURE, mine), (_OPEN, own & open_)):
            tx, tz, spans = _packed(c, root, np.flatnonzero(which))
            out.append((kind, tx, tz, spans, *[np.zeros(len(tx), np.int64)] * 3))
        add = lambda kind, a, b, n: out.append((kind, *[np.zeros(len(a), np.int32)] * 2, [b""] * len(a), a, b, n))
        ones = lambda v: np.ones(len(v), np.int64)
        good = mine[a] & ~own[b]
        add(_WAY, root[a[good]], ids[b[good]], ones(a[good]))
        i, k = np.nonzero((link >= 0) & mine[:, None])
        j = link[i, k]
        add(_ACROSS, root[i[~own[j]]], ids[j[~own[j]]], ones(i[~own[j]]))
        side = np.flatnonzero(mine & np.logical_or.reduce([(c[g] % TILE == v) for g in ("gx", "gz") for v in (0, TILE - 1)]))
        add(_SIDE, ids[side], root[side], ones(side))
        names, nth, counts = np.unique(root[mine], return_inverse=True, return_counts=True)
        add(_SIZE, names, names, counts)
        at = np.zeros(len(own), np.int64)
        at[mine] = nth
        p, q = at[i[own[j]]], at[j[own[j]]]
        pairs, counts = np.unique((np.minimum(p, q) * len(names) + np.maximum(p, q))[p != q], return_counts=True)
        add(_PAIR, names[pairs // max(len(names), 1)], names[pairs % max(len(names), 1)], counts)
        join = lambda n: np.concatenate([np.asarray(t[n], np.int64) for t in out])
        return {"kind": np.repeat([t[0] for t in out], [len(t[1]) for t in out]).astype(np.int32), "tx": join(1).astype(np.int32), "tz": join(2).astype(np.int32), "spans": sum((t[3] for t in out), []), "a": join(4), "b": join(5), "n": join(6)}

    # Few columns, as most of the time is spent on passing them to Python.
    return whole_tiles(rows.select(span_id().alias("id"), "room", "tx", "tz"), ["tx", "tz"], kernel, "kind int, tx int, tz int, spans binary, a long, b long, n long")


def _again(parts: DataFrame) -> DataFrame:
    """Spans of the tiles that are not sure, with the widest rings."""
    tiles = parts.where(F.col("kind") == _OPEN).select("tx", "tz").distinct()
    around = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)).alias(c)
    near = tiles.select(around("tx"), "tz").select("tx", around("tz")).distinct()

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = unpacked(batch.column("spans").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[k])) for k in SPAN], SPAN)

    packed = parts.where(F.col("kind").isin(_SURE, _OPEN)).join(near, ["tx", "tz"], "left_semi").select("spans")
    return in_tiles(packed.mapInArrow(spans, ", ".join(f"{k} int" for k in SPAN)), WIDEST).join(tiles, ["tx", "tz"], "left_semi")


def packed_regions(spans: DataFrame, climb: int, tall: int, least: int, merge: int) -> DataFrame | None:
    """What ``border_distance``, ``watershed`` and ``merge_regions`` find, by one look at tiles and rings that are wide enough for it; None if too few are.

    A tile's packed spans (``unpacked``) with their roots are rows of tx, tz, spans; what region spans of a root belong to is a row of the tile with root and
    region (and no spans). Spans of other roots are left out. Spans are shuffled twice, once for their regions and once, packed, by who reads the rows.
    """
    seen = Observation()
    rows = _at_once(in_tiles(spans.select(*SPAN), WIDE), climb, tall, WIDE)
    parts = written(rows.observe(seen, F.count_if(F.col("kind") == _SURE).alias("sure"), F.count_if(F.col("kind") == _OPEN).alias("open")), "tiles")
    count = seen.get
    if count["open"]:
        # Widest rings hold nine tiles' spans.
        if count["open"] > max(count["sure"] // 9, FEW_OPEN):
            return None
        seen = Observation()
        rows = _at_once(_again(parts), climb, tall, WIDEST)
        more = written(rows.observe(seen, F.count_if(F.col("kind") == _OPEN).alias("open")), "tiles")
        if seen.get["open"]:
            return None
        parts = parts.where(F.col("kind") != _OPEN).union(more)
    of = lambda kind: parts.where(F.col("kind") == kind)
    beyond = of(_SIDE).select(F.col("a").alias("across"), F.col("b").alias("other"))
    across = lambda kind: of(kind).select("a", F.col("b").alias("across")).join(beyond, "across").select("a", F.col("other").alias("b"))
    found = written(connected_components(across(_WAY), one_task=ONE_TASK_EDGES), "components")
    whole = lambda df, c: df.join(found.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("component", c)).drop("component")
    basins = written(whole(of(_SIZE).select(F.col("a").alias("root"), F.col("a").alias("region"), "n"), "region"), "basins")
    sizes = written(basins.groupBy("region").agg(F.sum("n").alias("n")), "regions")
    both = of(_PAIR).select("a", "b", "n").union(across(_ACROSS).select("a", "b", F.lit(1)))
    both = whole(whole(both, "a"), "b").where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("n").alias("sides"))
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    graph = written(both.select(ends.alias("e"), "sides").select("e.a", "e.b", "sides"), "sides")
    named = basins.join(merged(sizes, graph, least, merge), "region")
    named = named.select(*[v.alias(k) for k, v in zip(("tx", "tz"), _tile_of("root"), strict=True)], F.lit(b"").alias("spans"), "root", F.col("new").alias("region"))
    return of(_SURE).select("tx", "tz", "spans", F.lit(0).cast("long").alias("root"), F.lit(0).cast("long").alias("region")).union(named)

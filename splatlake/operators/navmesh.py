"""Walkable surface of a mesh: slope, height spans, obstacles, ledges, clearance, erosion, regions, polygons, triangles.

The mesh is cut into columns of cells; spans of a column are merged by windows over it, and
neighbouring columns meet in equi-joins. Distances and regions (``navfield``) and polygons (``navpoly``) are found tile by tile.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splatlake.functions import expr as X
from splatlake.functions.storage import written
from splatlake.operators import navfield, navpoly
from splatlake.operators.mesh import CORNERS

#: Free height where nothing is above.
OPEN = 1 << 30
#: Cells of a triangle's box from which on its rows are dealt out to several tasks.
LARGE = 1 << 14


@dataclass(frozen=True)
class NavmeshParams:
    enabled: bool = True
    agent_height: float = 1.6
    agent_radius: float = 0.2
    max_slope_degrees: float = 45.0
    cell_size: float = 0.1
    cell_height: float = 0.05
    walkable_climb: float = 0.25
    min_region_size: int = 4
    merge_region_size: int = 12

    @property
    def cell(self) -> float:
        return max(self.cell_size, 0.05)

    @property
    def height(self) -> float:
        return max(self.cell_height, 0.05)

    @property
    def climb(self) -> int:
        return int(self.walkable_climb / self.height)

    @property
    def tall(self) -> int:
        return math.ceil(self.agent_height / self.height)

    @property
    def radius(self) -> int:
        return math.ceil(max(self.agent_radius / self.cell, 0.1))


def _faces_up(n: list[Column], max_slope_degrees: float) -> Column:
    return (X.dot(n, n) > 0) & (n[1] > F.sqrt(X.dot(n, n)) * math.cos(math.radians(max_slope_degrees)))


def walkable_triangles(mesh: DataFrame, max_slope_degrees: float) -> DataFrame:
    """Triangles that face up with a slope of less than the limit."""
    a, b, c = [[F.col(f"{p}{k}") for k in "xyz"] for p in "abc"]
    return mesh.where(_faces_up(X.cross(X.minus(b, a), X.minus(c, a)), max_slope_degrees))


def spans(mesh: DataFrame, p: NavmeshParams) -> DataFrame:
    """Solid spans of columns: gx, gz, bottom and top (in cell heights), walkable (of the triangle that makes the top)."""
    low = lambda c: F.least(*[F.col(f"{v}{c}") for v in "abc"])
    high = lambda c: F.greatest(*[F.col(f"{v}{c}") for v in "abc"])
    cell = lambda v: F.floor(v / p.cell).cast("int")
    a, b, c = [[F.col(f"{v}{k}") for k in "xyz"] for v in "abc"]
    normal = dict(zip(("nx", "ny", "nz"), X.cross(X.minus(b, a), X.minus(c, a)), strict=True))
    t = X.computed(mesh, ["tid", *CORNERS], normal)
    t = t.withColumn("walkable", F.coalesce(_faces_up([F.col(k) for k in normal], p.max_slope_degrees), F.lit(False)))
    t = X.computed(t, ["tid", "walkable", *CORNERS, *normal], {"low": low("y"), "high": high("y")} | {f"{n}{k}": cell(f(k)) for n, f in (("low_", low), ("high_", high)) for k in "xz"})
    # The rows of a large triangle are dealt out before its cells are made.
    cells = (F.col("high_x") - F.col("low_x") + 1).cast("long") * (F.col("high_z") - F.col("low_z") + 1)
    rows = [t.where(cells <= LARGE), t.where(cells > LARGE)]
    rows = [r.withColumn("gz", F.explode(F.sequence("low_z", "high_z"))) for r in rows]
    t = rows[0].union(rows[1].repartition("tid", "gz")).withColumn("gx", F.explode(F.sequence("low_x", "high_x")))
    # The cell must meet the triangle: no edge may have the whole cell on its outer side.
    steep = F.abs(F.col("ny")) < 1e-9
    centre = [(F.col("gx") + 0.5) * p.cell, (F.col("gz") + 0.5) * p.cell]
    meets = {}
    for k, (s, e) in enumerate(((a, b), (b, c), (c, a))):
        ex, ez = e[0] - s[0], e[2] - s[2]
        side = ((centre[0] - s[0]) * ez - (centre[1] - s[2]) * ex) * F.when(F.col("ny") < 0, -1.0).otherwise(1.0)
        meets[f"m{k}"] = side > -(F.abs(ex) + F.abs(ez)) * p.cell / 2 - 1e-12
    # Of each triangle the heights over the cell's corners, cut to its own range.
    corner = [(F.col("gx") + i, F.col("gz") + j) for i in (0, 1) for j in (0, 1)]
    plane = {f"p{k}": F.try_divide(F.col("nx") * (a[0] - x * p.cell) + F.col("nz") * (a[2] - z * p.cell), F.col("ny")) + a[1] for k, (x, z) in enumerate(corner)}
    t = X.computed(t, ["gx", "gz", "walkable", "low", "high", "ny"], meets | plane).where(steep | (F.col("m0") & F.col("m1") & F.col("m2")))
    floor_ = F.when(steep, F.col("low")).otherwise(F.greatest(F.col("low"), F.least(*plane)))
    roof = F.when(steep, F.col("high")).otherwise(F.least(F.col("high"), F.greatest(*plane)))
    t = X.computed(t, ["gx", "gz", "walkable"], {"bottom": F.floor(floor_ / p.height).cast("int"), "roof": F.ceil(roof / p.height).cast("int")})
    t = t.select("gx", "gz", "bottom", F.greatest(F.col("roof"), F.col("bottom") + 1).alias("top"), "walkable")
    w = Window.partitionBy("gx", "gz").orderBy("bottom", "top")
    reach = F.max("top").over(w.rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("new", F.when(reach.isNull() | (F.col("bottom") > reach), 1).otherwise(0))
    t = t.withColumn("span", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy("gx", "gz", "span").agg(F.min("bottom").alias("bottom"), F.max("top").alias("top"), F.max_by("walkable", F.struct("top", "walkable")).alias("walkable")).drop("span")


def low_hanging(s: DataFrame, climb: int) -> DataFrame:
    """Spans of which one that can't be walked on may be, if it rises no more than ``climb`` over a walkable one next below it in its column."""
    below = Window.partitionBy("gx", "gz").orderBy("bottom")
    step = (F.col("top") - F.lag("top").over(below) <= climb) & F.lag("walkable").over(below)
    return s.withColumn("walkable", F.col("walkable") | F.coalesce(step, F.lit(False)))


def with_room(s: DataFrame) -> DataFrame:
    """Spans with ``room``, the free height above each."""
    ceiling = F.lead("bottom").over(Window.partitionBy("gx", "gz").orderBy("bottom"))
    return s.withColumn("room", F.coalesce(ceiling - F.col("top"), F.lit(OPEN)).cast("int"))


def ledges(s: DataFrame, climb: int, tall: int) -> DataFrame:
    """Spans (with room) of which none is walkable beside a drop of more than ``climb``, or on ground whose steps around it differ by more.

    On each side the places to stand are the spans of that column with ``tall`` free above both, and the
    bottomless one below its lowest span; a column without spans is a drop.
    """
    s = written(s, "room")
    stand = s.select("gx", "gz", F.col("top").alias("floor"), (F.col("top").cast("long") + F.col("room")).alias("ceiling"))
    below = s.groupBy("gx", "gz").agg(F.min("bottom").cast("long").alias("ceiling")).select("gx", "gz", F.lit(-OPEN).alias("floor"), "ceiling")
    places = stand.union(below).select(F.col("gx").alias("ox"), F.col("gz").alias("oz"), "floor", "ceiling")
    near = _stepped(s.where("walkable").select("gx", "gz", "top", "room")).join(places, ["ox", "oz"], "left")
    fits = F.least(F.col("top").cast("long") + F.col("room"), F.col("ceiling")) - F.greatest("top", "floor") >= tall
    step = F.when(fits, F.col("floor") - F.col("top"))
    reached = F.when(fits & (F.abs(F.col("floor") - F.col("top")) <= climb), F.col("floor") - F.col("top"))
    found = near.groupBy("gx", "gz", "top").agg(F.bool_or(F.col("floor").isNull() | F.coalesce(step < -climb, F.lit(False))).alias("drop"), (F.greatest(F.max(reached), F.lit(0)) - F.least(F.min(reached), F.lit(0))).alias("rise"))
    bad = found.where(F.col("drop") | F.coalesce(F.col("rise") > climb, F.lit(False))).select("gx", "gz", "top", F.lit(True).alias("bad"))
    return s.join(bad, ["gx", "gz", "top"], "left").withColumn("walkable", F.col("walkable") & F.col("bad").isNull()).drop("bad")


def _stepped(s: DataFrame) -> DataFrame:
    """Spans with the column (ox, oz) on each of their four sides."""
    steps = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(z).alias("z")) for x, z in navfield.STEPS])
    return s.withColumn("s", F.explode(steps)).select("*", (F.col("gx") + F.col("s.x")).alias("ox"), (F.col("gz") + F.col("s.z")).alias("oz")).drop("s")


def walkable_spans(mesh: DataFrame, p: NavmeshParams) -> DataFrame:
    """Spans (gx, gz, top, room) with clearance for the agent, off ledges, and with their distance ``dist`` to what can't be walked on, eroded by the agent's radius."""
    s = ledges(with_room(low_hanging(spans(mesh, p), p.climb)), p.climb, p.tall)
    s = written(s.where("walkable").where(F.col("room") >= p.tall).select(*navfield.SPAN), "spans")
    s = navfield.border_distance(s, p.climb, p.tall).where(F.col("dist") >= navfield.STRAIGHT * p.radius).select(*navfield.SPAN)
    return navfield.border_distance(s, p.climb, p.tall)


def regions(s: DataFrame, p: NavmeshParams) -> DataFrame:
    """Spans (with dist) with id and region: basins of the distance, small ones merged or left out."""
    return navfield.merge_regions(navfield.watershed(s, p.climb, p.tall), p.climb, p.tall, p.min_region_size**2, p.merge_region_size**2)


def bake_navmesh(mesh: DataFrame, p: NavmeshParams) -> DataFrame | None:
    """Triangles of the walkable surface with their region and the polygon of it, or None if there are none."""
    if not p.enabled:
        return None
    found = written(regions(walkable_spans(mesh, p), p), "regions")
    polygons = written(navpoly.region_polygons(found, p.climb, p.tall), "polygons")
    if not polygons.take(1):
        return None
    corner = F.transform(F.sequence(F.lit(0), F.size("triangles") - 1, F.lit(9)), lambda k: F.slice("triangles", k + 1, 9))
    rows = polygons.where(F.size("triangles") > 0).select("region", F.xxhash64("piece", "tx", "tz", "nth").alias("polygon"), F.posexplode(corner).alias("k", "t"))
    # Corners are turned round, so that the surface looks up.
    at = lambda k, scale: F.col("t")[k] * scale
    columns = [at(3 * v + n, p.height if n == 1 else p.cell).alias(c) for v, group in zip((0, 2, 1), (CORNERS[:3], CORNERS[3:6], CORNERS[6:]), strict=True) for n, c in enumerate(group)]
    return rows.select(F.xxhash64("polygon", "k").alias("tid"), *columns, "region", "polygon")

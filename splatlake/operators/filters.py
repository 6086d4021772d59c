"""Row filters and rigid transforms of splat tables."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splatlake.functions import expr as X

UP_AXES = {"x": (1.0, 0.0, 0.0), "y": (0.0, 1.0, 0.0), "z": (0.0, 0.0, 1.0), "neg-x": (-1.0, 0.0, 0.0), "neg-y": (0.0, -1.0, 0.0), "neg-z": (0.0, 0.0, -1.0)}


def finite_filter(splats: DataFrame) -> DataFrame:
    """Splats with finite position, scale and opacity; colour, rotation and harmonics are not looked at."""
    return splats.where(reduce(lambda a, b: a & b, [X.finite(X.d(c)) for c in ("x", "y", "z", "scale_0", "scale_1", "scale_2", "opacity")]))


def opacity_filter(splats: DataFrame, least: float) -> DataFrame:
    return splats.where(~F.isnan(X.d("opacity")) & (X.alpha() >= least))


def box_filter(splats: DataFrame, low: tuple, high: tuple) -> DataFrame:
    """Inclusive; plain comparisons of stored columns, so that Parquet can skip by them."""
    return splats.where(reduce(lambda a, b: a & b, [(F.col(c) >= lo) & (F.col(c) <= hi) for c, lo, hi in zip("xyz", low, high, strict=True)]))


def sphere_filter(splats: DataFrame, centre: tuple, radius: float) -> DataFrame:
    off = [X.d(c) - v for c, v in zip("xyz", centre, strict=True)]
    return splats.where(X.dot(off, off) <= radius * radius)


def _normal(v):
    n = math.sqrt(sum(c * c for c in v))
    return tuple(c / n for c in v)


def shortest_arc(a: tuple, b: tuple) -> tuple:
    """Unit quaternion (w, x, y, z) that turns direction a into b."""
    a, b = _normal(a), _normal(b)
    cos = sum(p * q for p, q in zip(a, b, strict=True))
    if cos > 1 - 1e-7:
        return (1.0, 0.0, 0.0, 0.0)
    if cos < -1 + 1e-7:  # half a turn about any axis across a
        other = (1.0, 0.0, 0.0) if abs(a[0]) < 0.9 else (0.0, 1.0, 0.0)
        axis = _normal((a[1] * other[2] - a[2] * other[1], a[2] * other[0] - a[0] * other[2], a[0] * other[1] - a[1] * other[0]))
        return (0.0, *axis)
    return (lambda q: tuple(c / math.sqrt(sum(v * v for v in q)) for c in q))((1 + cos, a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]))


def rotate(q: tuple, v: tuple) -> tuple:
    rows = X.matrix(list(q))
    return tuple(sum(row[k] * v[k] for k in range(3)) for row in rows)


@dataclass(frozen=True)
class Alignment:
    """p' = scale * R (p - origin)."""

    rotation: tuple = (1.0, 0.0, 0.0, 0.0)
    scale: float = 1.0
    origin: tuple = (0.0, 0.0, 0.0)

    @staticmethod
    def of(up_axis: str | None = None, floor_normal=None, scale_points=None, scale_distance: float | None = None, origin=None) -> Alignment:
        turn = (1.0, 0.0, 0.0, 0.0)
        if floor_normal is not None and sum(c * c for c in floor_normal) > 1.1920929e-07:
            turn = shortest_arc(tuple(floor_normal), UP_AXES[up_axis or "y"])
        scale = 1.0
        if scale_points is not None and scale_distance is not None:
            if not scale_distance > 0:
                raise ValueError("the scale distance must be positive")
            a, b = (rotate(turn, tuple(p)) for p in scale_points)
            measured = math.dist(a, b)
            if measured <= 1.1920929e-07:
                raise ValueError("the scale points are the same")
            scale = scale_distance / measured
        return Alignment(turn, scale, tuple(origin or (0.0, 0.0, 0.0)))

    @property
    def is_identity(self) -> bool:
        return self == Alignment()

    def point(self, p: tuple) -> tuple:
        return tuple(c * self.scale for c in rotate(self.rotation, tuple(a - b for a, b in zip(p, self.origin, strict=True))))

    def box(self, low: tuple, high: tuple) -> tuple[tuple, tuple]:
        """Box around the eight moved corners."""
        corners = [self.point((x, y, z)) for x in (low[0], high[0]) for y in (low[1], high[1]) for z in (low[2], high[2])]
        return tuple(map(min, zip(*corners, strict=True))), tuple(map(max, zip(*corners, strict=True)))


def align(splats: DataFrame, a: Alignment) -> DataFrame:
    """Move splats; spherical harmonics are not turned."""
    if a.is_identity:
        return splats
    return _moved(splats, a.rotation, a.scale, a.origin, (0.0, 0.0, 0.0))


def _moved(splats: DataFrame, q: tuple, scale: float, origin: tuple, shift: tuple) -> DataFrame:
    off = [X.d(c) - o for c, o in zip("xyz", origin, strict=True)]
    rows = X.matrix(list(q))
    new = {c: (row[0] * off[0] + row[1] * off[1] + row[2] * off[2]) * scale + s for c, row, s in zip("xyz", rows, shift, strict=True)}
    turned = X.product([F.lit(c) for c in q], X.unit_quaternion())
    new |= {f"rot_{i}": c for i, c in enumerate(turned)}
    new |= {f"scale_{i}": X.d(f"scale_{i}") + math.log(scale) for i in range(3)}
    return splats.withColumns(new)


@dataclass(frozen=True)
class SceneTransform:
    """Editor transform: turns about x, y and z in degrees, then a shift."""

    rotation: tuple = (0.0, 0.0, 0.0)
    translation: tuple = field(default=(0.0, 0.0, 0.0))

    def with_axis(self, part: str, axis: int, value: float) -> SceneTransform:
        """With one component of ``rotation`` or ``translation`` set; what is not finite becomes 0."""
        changed = list(getattr(self, part))
        changed[axis] = float(value) if math.isfinite(value) else 0.0
        return replace(self, **{part: tuple(changed)})

    @property
    def is_identity(self) -> bool:
        return not any((*self.rotation, *self.translation))

    def quaternion(self) -> tuple:
        turns = [tuple([math.cos(math.radians(v) / 2), *[math.sin(math.radians(v) / 2) * (k == i) for k in range(3)]]) for i, v in enumerate(self.rotation)]
        return tuple(X.product(X.product(list(turns[0]), list(turns[1])), list(turns[2])))


def transform_scene(splats: DataFrame, t: SceneTransform) -> DataFrame:
    if not all(map(math.isfinite, (*t.rotation, *t.translation))):
        raise ValueError("the transform has components that are not finite")
    if t.is_identity:
        return splats
    return _moved(splats, t.quaternion(), 1.0, (0.0, 0.0, 0.0), t.translation)


def center_bounds(splats: DataFrame) -> DataFrame:
    return splats.agg(*[f(X.d(c)).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"])


def gaussian_bounds(splats: DataFrame) -> DataFrame:
    """Box of three deviations around each splat, as lo_x .. hi_z."""
    names = splats.columns
    splats = X.computed(splats, names, {f"_u{i}": c for i, c in enumerate(X.unit_quaternion())})
    half = X.half_extents(X.matrix([F.col(f"_u{i}") for i in range(4)]), [F.exp(X.d(f"scale_{i}")) for i in range(3)])
    return X.computed(splats, names, {f"{n}_{c}": X.d(c) + s * half[k] for n, s in (("lo", -1), ("hi", 1)) for k, c in enumerate("xyz")})


def scene_bounds(splats: DataFrame) -> DataFrame:
    return gaussian_bounds(splats).agg(*[F.min(f"lo_{c}").alias(f"min_{c}") for c in "xyz"], *[F.max(f"hi_{c}").alias(f"max_{c}") for c in "xyz"])

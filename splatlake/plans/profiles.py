"""Settings made from two picked points and their real distance."""

from __future__ import annotations

import math

from splatlake.operators.filters import UP_AXES
from splatlake.plans.config import NavmeshConfig, ProcessConfig, VoxelCarveConfig, VoxelConfig, VoxelFillConfig

PROFILES = ("object-prop", "interior-room", "outdoor-terrain")
STORED_VERSION = 2


def up_axis_vector(up_axis: str) -> tuple:
    return UP_AXES[up_axis]


def collision_seed(up_axis: str, height: float = 1.0) -> tuple:
    return tuple(v * height for v in UP_AXES[up_axis])


def has_valid_scale(points: tuple, distance: float) -> bool:
    return all(math.isfinite(v) for p in points for v in p) and math.isfinite(distance) and distance > 1e-8 and math.dist(*points) > 1e-8


def make_process_config(points: tuple, distance: float, profile: str = "object-prop", up_axis: str = "y") -> ProcessConfig:
    """The seed is a real metre above the middle of the points."""
    up = UP_AXES[up_axis]
    unit = math.dist(*points) / distance if distance else 0.0
    if not math.isfinite(unit) or unit == 0:
        unit = 1.0
    seed = tuple((a + b) / 2 + u * unit for a, b, u in zip(*points, up, strict=True))
    fill = {"outdoor-terrain": VoxelFillConfig("floor-fill", 0.0), "interior-room": VoxelFillConfig("exterior-fill", 1.6)}.get(profile, VoxelFillConfig())
    inside = profile == "interior-room"
    return ProcessConfig(VoxelConfig(size=0.05, opacity_threshold=0.1), fill, VoxelCarveConfig(inside, 1.6, 0.2, seed), navmesh=NavmeshConfig(enabled=inside))


def make_alignment_recipe(distance: float, points: tuple, up_axis: str = "y", profile: str = "object-prop") -> dict:
    return {"alignmentRecipe": {"upAxis": up_axis, "floorNormal": list(UP_AXES[up_axis]), "scalePoints": [list(p) for p in points], "scaleDistanceMeters": distance, "origin": [0, 0, 0]}, "editRecipe": {"operations": []}}


def stored_profile_or_default(value: str | None, version: int | None) -> str:
    return value if version == STORED_VERSION and value in PROFILES else PROFILES[0]


def round3(v: float) -> float:
    return math.floor(v * 1000 + 0.5) / 1000


def intersect_ray_plane(origin: tuple, direction: tuple, point: tuple, normal: tuple) -> tuple:
    """Where a ray meets a plane, not behind its origin; the plane's point if they are parallel."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    along = dot(direction, normal)
    if abs(along) < 1e-8:
        return tuple(point)
    t = max(0.0, dot([p - o for p, o in zip(point, origin, strict=True)], normal) / along)
    return tuple(o + d * t for o, d in zip(origin, direction, strict=True))

"""Settings of a run: strict JSON, with defaults for whole blocks only."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from typing import Any


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(p.title() for p in rest)


def _read(cls, data: dict, optional: tuple = ()):
    """A block of settings; every key is needed but the optional ones, and no other is allowed to have another type."""
    if not isinstance(data, dict):
        raise ValueError(f"{cls.__name__} must be an object")
    values = {}
    for f in fields(cls):
        key = _camel(f.name)
        if key in data:
            values[f.name] = tuple(data[key]) if isinstance(data[key], list) else data[key]
        elif f.name not in optional:
            raise ValueError(f"{cls.__name__}: missing field {key}")
    return cls(**values)


def _one_of(value: str, *allowed: str) -> None:
    if value not in allowed:
        raise ValueError(f"unknown value {value}; expected one of {', '.join(allowed)}")


@dataclass(frozen=True)
class VoxelConfig:
    backend: str = "cpu"
    compare_cpu_gpu: bool = False
    size: float = 0.1
    opacity_threshold: float = 0.1

    def __post_init__(self):
        _one_of(self.backend, "cpu", "gpu")


@dataclass(frozen=True)
class VoxelFillConfig:
    mode: str = "none"
    dilation_size: float = 0.0

    def __post_init__(self):
        _one_of(self.mode, "none", "exterior-fill", "floor-fill")


@dataclass(frozen=True)
class VoxelCarveConfig:
    enabled: bool = False
    agent_height: float = 1.6
    agent_radius: float = 0.2
    seed_pos: tuple = (0.0, 0.0, 0.0)


@dataclass(frozen=True)
class MeshConfig:
    mode: str = "smooth"

    def __post_init__(self):
        _one_of(self.mode, "faces", "smooth")


@dataclass(frozen=True)
class NavmeshConfig:
    enabled: bool = True
    agent_height: float = 1.6
    agent_radius: float = 0.2
    max_slope_degrees: float = 45.0
    cell_size: float = 0.1
    cell_height: float = 0.05
    walkable_climb: float = 0.25
    min_region_size: int = 4
    merge_region_size: int = 12


@dataclass(frozen=True)
class ExportConfig:
    write_webar_zip: bool = True


@dataclass(frozen=True)
class ProcessConfig:
    voxel: VoxelConfig = field(default_factory=VoxelConfig)
    voxel_fill: VoxelFillConfig = field(default_factory=VoxelFillConfig)
    voxel_carve: VoxelCarveConfig = field(default_factory=VoxelCarveConfig)
    mesh: MeshConfig = field(default_factory=MeshConfig)
    navmesh: NavmeshConfig = field(default_factory=NavmeshConfig)
    export: ExportConfig = field(default_factory=ExportConfig)

    @staticmethod
    def from_json(text: str) -> ProcessConfig:
        data = json.loads(text)
        kinds = {"voxel": VoxelConfig, "voxel_fill": VoxelFillConfig, "voxel_carve": VoxelCarveConfig, "mesh": MeshConfig, "navmesh": NavmeshConfig, "export": ExportConfig}
        blocks = {n: _read(k, data[_camel(n)], ("backend", "compare_cpu_gpu") if n == "voxel" else ()) for n, k in kinds.items() if _camel(n) in data}
        return ProcessConfig(**blocks)

    def to_json(self) -> str:
        change = lambda v: {_camel(k): change(x) for k, x in v.items()} if isinstance(v, dict) else v
        return json.dumps(change(asdict(self)))


# Edit operations with their needed and optional fields.
OPERATIONS = {
    "selectAll": ((), {}),
    "selectNone": ((), {}),
    "filterOpacity": (("min",), {}),
    "filterBox": (("min", "max"), {}),
    "filterSphere": (("center", "radius"), {}),
    "filterCluster": (("coarseVoxelSize", "opacityThreshold", "seedPos"), {"minContribution": 0.1}),
    "filterFloatersByVoxelContribution": ((), {"minContribution": 0.1}),
}


@dataclass(frozen=True)
class Recipe:
    alignment: dict = field(default_factory=dict)
    operations: tuple[dict, ...] = ()

    @staticmethod
    def from_json(text: str) -> Recipe:
        data = json.loads(text)
        edit = data.get("editRecipe") or {}
        ops = []
        for op in edit.get("operations", edit.get("ops", [])):
            need, default = OPERATIONS.get(op.get("type"), (None, None))
            if need is None:
                raise ValueError(f"unknown operation {op.get('type')}")
            if missing := [k for k in need if k not in op]:
                raise ValueError(f"{op['type']}: missing field {missing[0]}")
            ops.append(default | op)
        return Recipe(data.get("alignmentRecipe") or {}, tuple(ops))


def read_or_default(path: str | None, kind: Any) -> Any:
    """Settings from a JSON file, or defaults without one."""
    if path is None:
        return kind()
    with open(path) as f:
        return kind.from_json(f.read())

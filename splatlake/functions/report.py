"""Texts for reports of runs."""

from __future__ import annotations

from splatlake.plans.process import STAGES

# Shown names of stages.
LABELS = dict(zip(STAGES, ("Decode source", "Apply alignment", "Apply edits", "Voxelize", "Fill volume", "Carve navigation", "Build collision mesh", "Bake navmesh", "Export bundle", "Complete"), strict=True))


def stage_progress(stage: str) -> int:
    """Percent done when a stage begins."""
    return round(100 * STAGES.index(stage) / (len(STAGES) - 1)) if stage in STAGES else 0


def stage_label(stage: str) -> str:
    return LABELS.get(stage, stage)


def format_bytes(n: float | None) -> str:
    return "-" if n is None else f"{n / 1024 / 1024:.2f} MB"


def format_number(n: float | None) -> str:
    return "-" if n is None else f"{n:,}"


def format_ratio(r: float | None) -> str:
    return "-" if r is None else f"{r:.2f}x"


def format_bounds(bounds: dict | None) -> str:
    return "-" if not bounds else " / ".join(" ".join(f"{v:.2f}" for v in bounds[k]) for k in ("min", "max"))

"""Row filters and occupancy on a stream of splats, once the grid is fixed."""

from __future__ import annotations

from pyspark.sql import DataFrame

from splatlake.operators.filters import finite_filter, opacity_filter
from splatlake.operators.voxel import Grid, contributions


def stream_solid_cells(splats: DataFrame, grid: Grid, threshold: float) -> DataFrame:
    """Solid cells as they first become so; the state is one row for each solid cell, which the grid bounds."""
    near = contributions(opacity_filter(finite_filter(splats), threshold), grid, threshold, [])
    return near.where(near["contribution"] >= threshold).select("cx", "cy", "cz").dropDuplicates(["cx", "cy", "cz"])

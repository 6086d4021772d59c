"""A whole run: splats to collision mesh, navigation mesh and metrics, stage by stage."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splatlake.functions.storage import written
from splatlake.operators import evaluate, filters, mesh, morph, navmesh, voxel
from splatlake.plans.config import ProcessConfig, Recipe

# Names of stages in order, and texts of warnings.
STAGES = ("decode", "alignment", "filters", "voxelize", "fill", "carve", "mesh", "navmesh", "export", "done")
NO_MESH = "collision mesh generated 0 triangles; check voxel size, opacity threshold, bake profile, or carve/fill seed"
NO_NAVMESH = "navmesh generated 0 triangles; likely causes are a blocked seed, empty carve result, wrong floor plane, or wrong up axis"


class Cancelled(RuntimeError):
    pass


@dataclass
class Result:
    splats: DataFrame
    cells: DataFrame
    grid: voxel.Grid
    mesh: DataFrame
    navmesh: DataFrame | None
    metrics: dict
    warnings: list[str] = field(default_factory=list)


def alignment_of(recipe: Recipe) -> filters.Alignment:
    a = recipe.alignment
    return filters.Alignment.of(a.get("upAxis"), a.get("floorNormal"), a.get("scalePoints"), a.get("scaleDistanceMeters"), a.get("origin"))


def process_table(splats: DataFrame, config: ProcessConfig, recipe: Recipe | None = None, errors: bool = True, progress: Callable[[str], None] = lambda stage: None, cancelled: Callable[[], bool] = lambda: False) -> Result:
    """Run all stages; results of a stage that several later ones read are written to the shared folder.

    Actions run only where a stage needs a number to go on: the grid, seeds, counts for the metrics.
    """
    recipe, spark = recipe or Recipe(), splats.sparkSession
    metrics: dict = {"voxelBackend": config.voxel.backend}
    warnings: list[str] = []
    clock = [time.time()]

    def stage(name: str, timed: str | None = None) -> None:
        if timed:
            metrics[timed] = int((time.time() - clock[0]) * 1000)
        clock[0] = time.time()
        if cancelled():
            raise Cancelled(name)
        spark.sparkContext.setJobDescription(name)
        progress(name)

    stage("decode")
    align = alignment_of(recipe)
    stage("alignment")
    metrics["sourceCount"] = splats.count()
    splats = filters.align(splats, align)
    stage("filters", "alignmentMs")
    splats = filters.finite_filter(splats)
    v = config.voxel
    floaters = None
    for op in recipe.operations:
        kind = op["type"]
        if kind == "filterOpacity":
            splats = filters.opacity_filter(splats, op["min"])
        elif kind == "filterBox":
            splats = filters.box_filter(splats, *align.box(tuple(op["min"]), tuple(op["max"])))
        elif kind == "filterSphere":
            splats = filters.sphere_filter(splats, align.point(tuple(op["center"])), op["radius"] * align.scale)
        elif kind == "filterCluster":
            splats = written(splats, "splats")
            before = splats.count()
            r = voxel.cluster_filter(splats, op["coarseVoxelSize"], op["opacityThreshold"], align.point(tuple(op["seedPos"])), op["minContribution"])
            splats = written(r.splats, "splats")
            kept = splats.count()
            if not kept:
                raise ValueError("the cluster filter removed all splats")
            asked, found = ([round(o + (c + 0.5) * r.grid.size, 6) for o, c in zip(r.grid.origin, cell, strict=True)] for cell in (r.requested, r.resolved))
            if r.requested != r.resolved:
                warnings.append(f"filterCluster seed resolved from {asked} to nearest occupied voxel {found}")
            metrics |= {"filterClusterInputCount": before, "filterClusterOutputCount": kept, "filterClusterRemovedCount": before - kept, "filterClusterRequestedSeed": asked, "filterClusterResolvedSeed": found, "filterClusterSeedResolved": r.requested != r.resolved, "filterClusterCells": r.component.count()}
        elif kind == "filterFloatersByVoxelContribution" and floaters is None:
            floaters = op  # the first one counts, after the voxels are there
    splats = written(splats, "splats")
    stage("voxelize")
    grid = voxel.grid_of(splats, v.size)
    cells = written(voxel.solid_cells(splats, grid, v.opacity_threshold), "cells")
    if floaters is not None:
        before = splats.count()
        splats = written(voxel.floater_filter(splats, cells, grid, v.opacity_threshold, floaters["minContribution"]), "splats")
        kept = splats.count()
        metrics |= {"floaterFilterInputCount": before, "floaterFilterOutputCount": kept, "floaterFilterRemovedCount": before - kept}
        grid = voxel.grid_of(splats, v.size)
        cells = written(voxel.solid_cells(splats, grid, v.opacity_threshold), "cells")
    metrics |= {"keptCount": splats.count(), "voxelSolidCells": cells.count(), "voxelGridDims": list(grid.dims)}
    if v.compare_cpu_gpu:
        metrics["cpuGpuVoxelMismatches"] = voxel.mismatch_count(cells, voxel.solid_cells(splats, grid, v.opacity_threshold)).head()[0]
    stage("fill", "voxelMs")
    seed = align.point(config.voxel_carve.seed_pos)
    filled = morph.fill(cells, grid, config.voxel_fill.mode, config.voxel_fill.dilation_size * 1.0, seed)
    warnings += filled.warnings
    cells = written(filled.cells, "filled")
    metrics |= {"filledSolidCells": cells.count(), "filledGridDims": list(grid.dims)}
    stage("carve", "fillMs")
    metrics |= {"carveRequestedSeed": list(seed), "carveResolvedSeed": None, "carveReachableCells": 0}
    c = config.voxel_carve
    if c.enabled:
        carved = morph.carve(cells, grid, c.agent_height, c.agent_radius, seed)
        warnings += carved.warnings
        cells = written(carved.cells, "carved")
        if carved.reachable is not None:
            reached = carved.reachable.agg(F.coalesce(F.sum(F.col("x1") - F.col("x0") + 1), F.lit(0))).head()[0]
            metrics |= {"carveReachableCells": reached, "carveResolvedSeed": [o + (k + 0.5) * grid.size for o, k in zip(grid.origin, carved.resolved_seed, strict=True)]}
            if not reached:
                warnings.append(morph.CARVE_UNREACHED)
            elif not cells.take(1):
                warnings.append(morph.CARVE_NO_BORDER)
    metrics |= {"carvedSolidCells": cells.count(), "carvedGridDims": list(grid.dims)}
    stage("mesh", "carveMs")
    cropped, small = morph.crop(cells, grid)
    whole = written(mesh.face_mesh(cropped, small) if config.mesh.mode == "faces" else mesh.smooth_mesh(cropped, small), "mesh")
    before = whole.count()
    out = whole if config.mesh.mode == "faces" or not before else written(mesh.merge_rectangles(whole), "merged")
    after = out.count()
    metrics |= {"croppedSolidCells": cropped.count(), "croppedGridDims": list(small.dims), "collisionTrianglesBeforeMerge": before, "collisionTrianglesAfterMerge": after, "collisionTriangles": after}
    if not after:
        warnings.append(NO_MESH)
    if errors:
        e = evaluate.error_summary(evaluate.point_errors(evaluate.stride_sample(splats), out)).head()
        metrics |= {"geometricErrorSampleCount": e["sample_count"], "geometricErrorMean": e["mean"], "geometricErrorRms": e["rms"], "geometricErrorP95": e["p95"]}
    stage("navmesh", "meshMs")
    n = config.navmesh
    nav = navmesh.bake_navmesh(out, navmesh.NavmeshParams(**vars(n))) if n.enabled and after else None
    nav = written(nav, "navmesh") if nav is not None else None
    metrics["navmeshTriangles"] = nav.count() if nav is not None else 0
    if n.enabled and nav is None:
        warnings.append(NO_NAVMESH)
    stage("export", "navmeshMs")
    metrics["collisionWarnings"] = warnings
    return Result(splats, cells, grid, out, nav, metrics, warnings)


def size_ratio(a: int, b: int) -> float | None:
    return a / b if a and b else None


def process_file(spark: SparkSession, source: str, out_dir: str, config: ProcessConfig | None = None, recipe: Recipe | None = None) -> dict:
    """Read a source, run all stages and write meshes, the edited scene and the manifest to a local folder."""
    from splatlake.sinks import files
    from splatlake.sources.readers import read_source

    config = config or ProcessConfig()
    splats, kind = read_source(spark, source)
    result = process_table(splats, config, recipe)
    os.makedirs(out_dir, exist_ok=True)
    return files.write_outputs(result, out_dir, source, kind, config)


def benchmark(spark: SparkSession, source: str, out_dir: str, config: ProcessConfig, compare: bool) -> dict:
    config = replace(config, voxel=replace(config.voxel, compare_cpu_gpu=compare), export=replace(config.export, write_webar_zip=False))
    return process_file(spark, source, out_dir, config)

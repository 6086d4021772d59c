"""Readers, writers, settings and whole runs."""

import json
import math
import struct
import zipfile

import numpy as np
import pytest

from splatlake.functions import expr as X
from splatlake.operators.filters import SceneTransform
from splatlake.plans import profiles
from splatlake.plans.config import MeshConfig, NavmeshConfig, ProcessConfig, Recipe, VoxelConfig
from splatlake.plans.process import process_file, process_table
from splatlake.sinks import files
from splatlake.sources import readers

ROW = struct.pack("<6f8B", 1, 2, 3, 1, 2, 4, 255, 128, 0, 128, 128, 128, 128, 128)
SCHEMA = "splat_id long, " + ", ".join(f"{c} double" for c in X.SCALARS) + ", f_rest array<double>"


def test_splat_reader(spark, tmp_path):
    p = tmp_path / "a.splat"
    p.write_bytes(ROW)
    r = readers.read_source(spark, str(p))[0].collect()
    assert len(r) == 1 and abs(r[0]["scale_1"] - math.log(2)) < 1e-6 and r[0]["x"] == 1
    for bad in (b"", b"\0" * 31, struct.pack("<6f8B", 0, 0, 0, 0, 1, 1, *[0] * 8)):
        with pytest.raises(readers.SourceError):
            list(readers.splat_batches(bad))
    assert readers.source_metadata(str(p))["splatCount"] == 1
    with pytest.raises(readers.SourceError):
        readers.read_source(spark, "a.obj")


def test_splat_and_ply_round_trip(spark, tmp_path):
    s = spark.createDataFrame([(i, 1.0 + i, 2.0, 3.0, 0.0, 0.5, 1.0, 0.0, 0.1, -0.2, 0.3, 1.0, 0.0, 0.0, 0.0, [0.5] * 9) for i in range(3)], SCHEMA)
    files.write_splat(s, str(tmp_path / "a.splat"))
    back = readers.read_splat(spark, str(tmp_path / "a.splat")).orderBy("splat_id").collect()
    assert len(back) == 3 and abs(back[0]["scale_1"] - 0.5) < 1e-6 and abs(1 / (1 + math.exp(-back[0]["opacity"])) - 0.5019608) < 1e-6
    files.write_ply(s, str(tmp_path / "a.ply"))
    ply = readers.read_ply(spark, str(tmp_path / "a.ply")).orderBy("splat_id").collect()
    assert [r["x"] for r in ply] == [1, 2, 3] and ply[0]["f_rest"] == []
    assert readers.ply_metadata(str(tmp_path / "a.ply")) == (3, (14 + 9) * 4)


def test_ply_errors_and_mixed_types():
    head = lambda *lines: ("\n".join(["ply", "format binary_little_endian 1.0", *lines, "end_header"]) + "\n").encode()
    with pytest.raises(readers.SourceError, match="missing vertex"):
        readers.ply_header(head("comment x"))
    with pytest.raises(readers.SourceError, match="end_header"):
        readers.ply_header(b"ply\n")
    kinds = {"x": "double", "y": "int", "z": "uint", "opacity": "short"}
    props = [f"property {kinds.get(c, 'float')} {c}" for c in X.SCALARS] + ["property uchar extra"]
    fmt = {"double": "d", "int": "i", "uint": "I", "short": "h", "float": "f"}
    values = {"x": 1.5, "y": 2, "z": 3, "opacity": 1, "rot_0": 1.0}
    data = head("element vertex 1", *props) + b"".join(struct.pack("<" + fmt[kinds.get(c, "float")], values.get(c, 0)) for c in X.SCALARS) + b"\7"
    r = next(iter(readers.ply_batches(data))).to_pylist()[0]
    assert (r["x"], r["y"], r["z"], r["opacity"]) == (1.5, 2, 3, 1)
    with pytest.raises(readers.SourceError, match="cut off"):
        list(readers.ply_batches(data[:-1]))


@pytest.mark.parametrize("rest", [0, 9, 45])
def test_sog_round_trip(spark, tmp_path, rest):
    h = math.sqrt(0.5)
    s = spark.createDataFrame([(i, 1.0 - 3 * i, 2.0, 0.5 * i, -1.0, -1.2, -0.8, 1.5, 0.1, -0.2, 0.3, h, 0.0, 0.0, h, [0.1 * k - 0.2 * i for k in range(rest)]) for i in range(2)], SCHEMA)
    files.write_sog(s, str(tmp_path / "a.sog"))
    a = s.orderBy("splat_id").collect()
    with zipfile.ZipFile(tmp_path / "a.sog") as z:
        z.extractall(tmp_path / "dir")
    for path in (tmp_path / "a.sog", tmp_path / "dir" / "meta.json"):
        b = readers.read_source(spark, str(path))[0].orderBy("splat_id").collect()
        for p, q in zip(a, b, strict=True):
            assert all(abs(p[c] - q[c]) < 0.001 for c in "xyz") and abs(p["scale_1"] - q["scale_1"]) < 0.01
            assert abs(sum(p[f"rot_{i}"] * q[f"rot_{i}"] for i in range(4))) > 0.999
            assert len(q["f_rest"]) == rest and np.allclose(p["f_rest"], q["f_rest"], atol=0.05)
    meta = json.loads((tmp_path / "dir" / "meta.json").read_text())
    meta["scales"]["codebook"] = meta["scales"]["codebook"][:3]
    (tmp_path / "dir" / "meta.json").write_text(json.dumps(meta))
    with pytest.raises(readers.SourceError, match="beyond the 3 entries"):
        readers.read_source(spark, str(tmp_path / "dir" / "meta.json"))
    with pytest.raises(ValueError):
        files.write_sog(s.withColumn("f_dc_0", X.F.lit(float("nan"))), str(tmp_path / "b.sog"))


def test_settings():
    assert ProcessConfig.from_json("{}") == ProcessConfig()
    with pytest.raises(ValueError, match="opacityThreshold"):
        ProcessConfig.from_json('{"voxel": {"size": 1}}')
    with pytest.raises(ValueError):
        ProcessConfig.from_json('{"mesh": {"mode": "round"}}')
    r = Recipe.from_json('{"editRecipe": {"operations": [{"type": "filterCluster", "coarseVoxelSize": 1, "opacityThreshold": 0.1, "seedPos": [0, 0, 0]}]}}')
    assert r.operations[0]["minContribution"] == 0.1
    with pytest.raises(ValueError):
        Recipe.from_json('{"editRecipe": {"operations": [{"type": "filterBox", "min": [0, 0, 0]}]}}')
    c = profiles.make_process_config(((0, 0, 0), (4, 0, 0)), 2.0, "interior-room", "z")
    assert c.voxel_carve.seed_pos == (2.0, 0.0, 2.0) and c.voxel_fill.mode == "exterior-fill" and c.navmesh.enabled
    assert profiles.stored_profile_or_default("interior-room", 1) == "object-prop"
    assert profiles.intersect_ray_plane((0, 1, 0), (0, -1, 0), (0, 0, 0), (0, 1, 0)) == (0, 0, 0)


def test_aligned_seed(spark):
    s = spark.createDataFrame([(i, x, 0.0, 0.0, *[math.log(0.3)] * 3, 8.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, []) for i, x in enumerate((2.0, 4.0))], SCHEMA)
    recipe = Recipe({"scalePoints": [[0, 0, 0], [2, 0, 0]], "scaleDistanceMeters": 1.0}, ({"type": "filterCluster", "coarseVoxelSize": 0.1, "opacityThreshold": 0.05, "seedPos": [2, 0, 0], "minContribution": 0.1},))
    r = process_table(s, ProcessConfig(voxel=VoxelConfig(size=0.1), mesh=MeshConfig("faces"), navmesh=NavmeshConfig(enabled=False)), recipe, errors=False)
    assert r.metrics["keptCount"] == 1 and abs(r.splats.head()["x"] - 1) < 1e-9


def test_whole_run(spark, tmp_path):
    source, out = tmp_path / "a.splat", tmp_path / "out"
    source.write_bytes(struct.pack("<6f8B", 0, 0, 0, 0.3, 0.3, 0.3, 200, 100, 50, 255, 255, 128, 128, 128))
    out.mkdir()
    (out / "navmesh.bin").write_bytes(b"stale")
    config = ProcessConfig(voxel=VoxelConfig(size=0.25, opacity_threshold=0.05), mesh=MeshConfig("faces"), navmesh=NavmeshConfig(enabled=False))
    m = process_file(spark, str(source), str(out), config)
    assert m["metrics"]["voxelSolidCells"] == 88 and m["metrics"]["collisionTriangles"] == 288 and not (out / "navmesh.bin").exists()
    assert (out / "collision.glb").read_bytes()[:8] == b"glTF" + struct.pack("<I", 2)
    assert json.loads((out / "manifest.json").read_text()) == json.loads(json.dumps(m))
    assert "manifest.json" in zipfile.ZipFile(out / "bundle.zip").namelist()


def test_edited_export(spark, tmp_path):
    s = spark.createDataFrame([(0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, [])], SCHEMA)
    r = files.export_edited_source(s, SceneTransform((0.0, 0.0, 90.0), (0.0, 2.0, 0.0)), str(tmp_path / "e.ply"))
    assert r["splatCount"] == 1 and abs(readers.read_ply(spark, r["path"]).head()["y"] - 3) < 1e-5
    with pytest.raises(ValueError):
        files.export_edited_source(s, SceneTransform((float("nan"), 0.0, 0.0)), str(tmp_path / "f.ply"))


def test_stream(spark, tmp_path):
    from splatlake.operators.voxel import grid_of, solid_cells
    from splatlake.sources.tables import bench_scene
    from splatlake.streaming.voxels import stream_solid_cells

    s = bench_scene(spark, 500)
    s.write.parquet(str(tmp_path / "in"))
    g = grid_of(s, 0.5)
    q = stream_solid_cells(spark.readStream.schema(s.schema).parquet(str(tmp_path / "in")), g, 0.05).writeStream.format("memory").queryName("voxels").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("voxels").count() == solid_cells(s, g, 0.05).count()


def test_commands(spark, tmp_path, capsys):
    from splatlake.__main__ import main
    from splatlake.functions import report

    made = main(["generate-bench-scenes", "--out", str(tmp_path), "--count", "8", "--count", "13"])
    assert [s["bytes"] for s in made["scenes"]] == [256, 416]
    row = readers.read_splat(spark, str(tmp_path / "bench-8.splat")).orderBy("splat_id").head()
    assert (tmp_path / "bench-8.splat").read_bytes()[24:32] == bytes([80, 120, 160, 220, 255, 128, 128, 128]) and row["x"] < 0
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"voxel": {"size": 0.05, "opacityThreshold": 0.1}, "mesh": {"mode": "faces"}, "navmesh": {"enabled": False, "agentHeight": 1.6, "agentRadius": 0.2, "maxSlopeDegrees": 45, "cellSize": 0.1, "cellHeight": 0.05, "walkableClimb": 0.25, "minRegionSize": 4, "mergeRegionSize": 12}}))
    m = main(["benchmark", str(tmp_path / "bench-13.splat"), "--out", str(tmp_path / "out"), "--config", str(config), "--compare-cpu-gpu"])
    assert m["metrics"]["cpuGpuVoxelMismatches"] == 0 and m["splatCount"] == 13 and not (tmp_path / "out" / "bundle.zip").exists()
    assert report.stage_progress("done") == 100 and report.format_ratio(2) == "2.00x" and report.format_bounds(None) == "-"

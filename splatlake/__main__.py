"""Commands: process, benchmark, generate-bench-scenes."""

from __future__ import annotations

import argparse
import json
import os

from splatlake.plans.config import ProcessConfig, Recipe, read_or_default


def generate_bench_scenes(spark, out: str, counts: list[int]) -> dict:
    """Write bench-<count>.splat files and benchmark-scenes.json."""
    from splatlake.sinks.files import write_splat
    from splatlake.sources.tables import bench_scene

    os.makedirs(out, exist_ok=True)
    scenes = []
    for count in counts:
        path = os.path.join(out, f"bench-{count}.splat")
        write_splat(bench_scene(spark, count), path)
        scenes.append({"name": os.path.basename(path), "splatCount": count, "bytes": os.path.getsize(path)})
    with open(os.path.join(out, "benchmark-scenes.json"), "w") as f:
        json.dump({"scenes": scenes}, f, indent=2)
    return {"scenes": scenes}


def main(argv: list[str] | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="splatlake")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("process", "benchmark"):
        c = commands.add_parser(name)
        c.add_argument("input")
        c.add_argument("--out", required=True)
        c.add_argument("--config")
        c.add_argument("--recipe" if name == "process" else "--compare-cpu-gpu", **({} if name == "process" else {"action": "store_true"}))
    c = commands.add_parser("generate-bench-scenes")
    c.add_argument("--out", required=True)
    c.add_argument("--count", type=int, action="append")
    a = parser.parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    from splatlake.plans import process

    if a.command == "generate-bench-scenes":
        result = generate_bench_scenes(spark, a.out, a.count or [500_000, 5_000_000, 10_000_000])
    else:
        config = read_or_default(a.config, ProcessConfig)
        if a.command == "process":
            result = process.process_file(spark, a.input, a.out, config, read_or_default(a.recipe, Recipe))
        else:
            result = process.benchmark(spark, a.input, a.out, config, a.compare_cpu_gpu)
    print(json.dumps(result, indent=2))
    return result


if __name__ == "__main__":
    main()

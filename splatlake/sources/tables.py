"""Splat-shaped views of the test tables, on exact binary fractions, with the same views in SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _e(i: int):
    return F.element_at("embedding", i).cast("double")


def splats_from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole splats, spherical harmonics included."""
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    f = lambda i, m, q: F.floor(_e(i) * m).cast("double") / q
    return t.select(
        F.col("vec_id").alias("splat_id"), *[f(i + 1, 128, 16).alias(c) for i, c in enumerate("xyz")], *[(f(i + 4, 8, 8) - 1.5).alias(f"scale_{i}") for i in range(3)], (f(7, 32, 4) + 0.5).alias("opacity"),
        *[f(i + 8, 1024, 1024).alias(f"f_dc_{i}") for i in range(3)], *[f(i + 11, 1024, 1024).alias(f"rot_{i}") for i in range(4)], F.transform(F.slice("embedding", 15, 45), lambda v: F.floor(v.cast("double") * 1024).cast("double") / 1024).alias("f_rest"),
    )


_f = lambda i, m, q: f"floor(CAST(embedding[{i}] AS DOUBLE) * {m}) / {q}.0"
SPLATS_SQL = (
    "SELECT vec_id AS splat_id, " + ", ".join(f"{_f(i + 1, 128, 16)} AS {c}" for i, c in enumerate("xyz")) + ", " + ", ".join(f"{_f(i + 4, 8, 8)} - 1.5 AS scale_{i}" for i in range(3)) + f", {_f(7, 32, 4)} + 0.5 AS opacity, "
    + ", ".join(f"{_f(i + 8, 1024, 1024)} AS f_dc_{i}" for i in range(3)) + ", " + ", ".join(f"{_f(i + 11, 1024, 1024)} AS rot_{i}" for i in range(4))
    + ", list_transform(embedding[15:59], lambda v: floor(CAST(v AS DOUBLE) * 1024) / 1024.0) AS f_rest FROM embeddings"
)


def splats_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large scene of round splats; ids are not unique, so for operators that ignore order."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lattice = lambda c, m, s: ((F.col(c) % m) * s).cast("double")
    zero = F.lit(0.0)
    return t.select(
        F.col("l_orderkey").alias("splat_id"), lattice("l_orderkey", 97, 0.125).alias("x"), lattice("l_partkey", 23, 0.125).alias("y"), lattice("l_suppkey", 61, 0.125).alias("z"), *[(-2.5 - (F.col("l_linenumber") % 4) * 0.25).cast("double").alias(f"scale_{i}") for i in range(3)],
        (F.col("l_quantity") / 16 - 1).cast("double").alias("opacity"), *[zero.alias(f"f_dc_{i}") for i in range(3)], F.lit(1.0).alias("rot_0"), *[zero.alias(f"rot_{i}") for i in (1, 2, 3)], F.array().cast("array<double>").alias("f_rest"),
    )


LINE_SPLATS_SQL = (
    "SELECT l_orderkey AS splat_id, CAST((l_orderkey % 97) * 0.125 AS DOUBLE) AS x, CAST((l_partkey % 23) * 0.125 AS DOUBLE) AS y, CAST((l_suppkey % 61) * 0.125 AS DOUBLE) AS z, "
    + ", ".join(f"CAST(-2.5 - (l_linenumber % 4) * 0.25 AS DOUBLE) AS scale_{i}" for i in range(3))
    + ", CAST(l_quantity / 16 - 1 AS DOUBLE) AS opacity, 0.0::DOUBLE AS f_dc_0, 0.0::DOUBLE AS f_dc_1, 0.0::DOUBLE AS f_dc_2, 1.0::DOUBLE AS rot_0, 0.0::DOUBLE AS rot_1, 0.0::DOUBLE AS rot_2, 0.0::DOUBLE AS rot_3 FROM lineitem"
)


def island_cells(spark: SparkSession, sf_dir: str, per: int = 60) -> DataFrame:
    """Solid cells, one for each event, in a lattice of 16 by 20 that grows in length with the table: a layer for every ``per`` events."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    return t.select(F.floor(F.col("event_id") / per).cast("int").alias("cx"), (F.col("user_id") % 16).cast("int").alias("cy"), ((F.col("event_id") + 7 * F.col("user_id")) % 20).cast("int").alias("cz")).distinct()


def island_layers(spark: SparkSession, sf_dir: str, per: int = 60) -> int:
    return spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.floor(F.max("event_id") / per).cast("int") + 1).head()[0] or 1


def island_sql(per: int = 60) -> str:
    return f"SELECT DISTINCT CAST(event_id // {per} AS INTEGER) AS cx, CAST(user_id % 16 AS INTEGER) AS cy, CAST((event_id + 7 * user_id) % 20 AS INTEGER) AS cz FROM events"


ISLAND_SQL = island_sql()


def bench_scene(spark: SparkSession, count: int) -> DataFrame:
    """The generated benchmark scene: a cube lattice of small, nearly opaque splats."""
    side = 1
    while side**3 < count:
        side += 1
    n = F.col("splat_id")
    ix, iy, iz = n % side, (n / side).cast("long") % side, (n / (side * side)).cast("long")
    sigma = 0.035 + (n % 11) * 0.001
    byte = lambda m, a: ((n % m + a) / 255 - 0.5) / 0.2820948
    half = side * 0.5
    a = 220 / 255
    return spark.range(count).withColumnRenamed("id", "splat_id").select(
        "splat_id", ((ix - half) * 0.08).alias("x"), (iy * 0.04).alias("y"), ((iz - half) * 0.08).alias("z"), F.log(sigma).alias("scale_0"), F.log(sigma).alias("scale_1"), F.log(sigma * 0.8).alias("scale_2"), F.lit(math.log(a / (1 - a))).alias("opacity"),
        byte(100, 80).alias("f_dc_0"), byte(80, 120).alias("f_dc_1"), byte(60, 160).alias("f_dc_2"), F.lit(1.0).alias("rot_0"), *[F.lit(128 / 255 * 2 - 1).alias(f"rot_{i}") for i in (1, 2, 3)], F.array().cast("array<double>").alias("f_rest"),
    )

"""Quantisation of splats for the SOG format, as expressions, and its inverse."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splatlake.functions import expr as X

PALETTE = 65536


def signed_log(v: Column) -> Column:
    return F.signum(v) * F.log(F.abs(v) + 1)


def signed_exp(v: Column) -> Column:
    return F.signum(v) * (F.exp(F.abs(v)) - 1)


def ranges(splats: DataFrame, columns: dict[str, Column]) -> dict[str, tuple[float, float]]:
    """Smallest and largest value of each expression (0, 0 without rows); not finite values are refused."""
    r = splats.agg(*[f(c).alias(f"{m}{k}") for k, c in columns.items() for m, f in (("lo_", F.min), ("hi_", F.max))]).head()
    out = {k: (r[f"lo_{k}"] or 0.0, r[f"hi_{k}"] or 0.0) for k in columns}
    if not all(map(math.isfinite, (v for x in out.values() for v in x))):
        raise ValueError("values that are not finite can't be exported")
    return out


def code(v: Column, low: float, high: float, most: int = 255) -> Column:
    """Nearest of most + 1 even steps from low to high; 0 if they are the same."""
    return F.lit(0) if high == low else F.round(X.clamp01((v - low) / (high - low)) * most).cast("int")


def means(splats: DataFrame) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """splat_id and 16-bit codes (mx, my, mz) of signed logarithms of positions."""
    logs = {c: signed_log(X.d(c)) for c in "xyz"}
    r = ranges(splats, logs)
    return splats.select("splat_id", *[code(v, *r[c], 65535).alias(f"m{c}") for c, v in logs.items()]), r


def codebook_codes(splats: DataFrame, names: list[str]) -> tuple[DataFrame, float, float]:
    """splat_id and 8-bit codes (c_<name>) of columns that share one even codebook."""
    r = ranges(splats, {n: X.d(n) for n in names})
    low, high = min(v[0] for v in r.values()), max(v[1] for v in r.values())
    return splats.select("splat_id", *[code(X.d(n), low, high).alias(f"c_{n}") for n in names]), low, high


def quat_pack(splats: DataFrame) -> DataFrame:
    """splat_id and bytes q0..q2 and tag: the three smaller components, the largest made positive (the last of equals)."""
    q = X.unit_quaternion()
    out = splats.select("splat_id", *[c.alias(f"u{i}") for i, c in enumerate(q)])
    size = [F.abs(F.col(f"u{i}")) for i in range(4)]
    most = F.greatest(*size)
    out = out.withColumn("largest", F.when(size[3] == most, 3).when(size[2] == most, 2).when(size[1] == most, 1).otherwise(0))
    sign = F.when(F.element_at(F.array(*[F.col(f"u{i}") for i in range(4)]), F.col("largest") + 1) < 0, -1.0).otherwise(1.0)
    rest = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"u{i}").alias("v")) for i in range(4)]), lambda s: s["i"] != F.col("largest"))
    byte = lambda v: F.round((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v * sign * math.sqrt(2))) + 1) / 2 * 255).cast("int")
    return out.withColumn("rest", rest).select("splat_id", *[byte(F.col("rest")[k]["v"]).alias(f"q{k}") for k in range(3)], (F.col("largest") + 252).alias("tag"))


def quat_unpack(q: list[Column], tag: Column) -> list[Column]:
    """Quaternion (w, x, y, z) of bytes; the identity for other tags."""
    small = [(v / 255 * 2 - 1) / math.sqrt(2) for v in q]
    big = F.sqrt(F.greatest(F.lit(0.0), 1 - X.dot(small, small)))
    out = []
    for i in range(4):
        c = F.when(tag == 252 + i, big)
        for largest in range(4):
            if largest != i:
                c = c.when(tag == 252 + largest, small[i if i < largest else i - 1])
        out.append(c.otherwise(1.0 if i == 0 else 0.0))
    return out


def sh_palette(splats: DataFrame, row: str, palette: int = PALETTE) -> DataFrame:
    """label, coeff and mean value of harmonics over the splats whose row number falls on the label."""
    return splats.select((F.col(row) % palette).alias("label"), F.posexplode("f_rest").alias("coeff", "v")).groupBy("label", "coeff").agg(F.avg("v").alias("centroid"))

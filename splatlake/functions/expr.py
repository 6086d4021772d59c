"""Column expressions on splats; all arithmetic is in DOUBLE.

A splat table has splat_id, x, y, z, scale_0..2 (natural log of the linear deviation), opacity (logit),
f_dc_0..2, rot_0..3 (quaternion w, x, y, z) and f_rest (array, channel-major).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGMA_CUTOFF = 3.0
MIN_SIGMA = 1e-6
SH_C0 = 0.2820948
SCALARS = ["x", "y", "z", "scale_0", "scale_1", "scale_2", "opacity", "f_dc_0", "f_dc_1", "f_dc_2", "rot_0", "rot_1", "rot_2", "rot_3"]


def d(name: str) -> Column:
    return F.col(name).cast("double")


def alpha(opacity: Column | None = None) -> Column:
    """Linear opacity of a logit."""
    return 1 / (1 + F.exp(-(d("opacity") if opacity is None else opacity)))


def logit(a: Column) -> Column:
    return F.log(a / (1 - a))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def unit_quaternion() -> list[Column]:
    """Normalised rotation; the identity if the length is zero or not a number."""
    q = [d(f"rot_{i}") for i in range(4)]
    n = F.sqrt(reduce(lambda a, b: a + b, [c * c for c in q]))
    good = finite(n) & (n > 0)
    return [F.when(good, c / n).otherwise(F.lit(1.0 if i == 0 else 0.0)) for i, c in enumerate(q)]


def matrix(q: list[Column]) -> list[list[Column]]:
    w, x, y, z = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def computed(df: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """Columns to keep and new ones, computed once.

    Filters on new columns would be pushed below a plain projection with their whole expressions put in for
    the names, again and again in a chain of them; they are not pushed below this generator of one row.
    """
    one = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*keep, one)


def product(a: list, b: list) -> list:
    """Quaternion a * b."""
    aw, ax, ay, az = a
    bw, bx, by, bz = b
    return [aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw]


def half_extents(r: list[list[Column]], sigma: list[Column], reach: Column | float = SIGMA_CUTOFF) -> list[Column]:
    """Half sizes of the box around an ellipsoid of ``reach`` deviations."""
    return [reduce(lambda a, b: a + b, [F.abs(row[c]) * sigma[c] for c in range(3)]) * reach for row in r]


def mahalanobis2(r: list[list[Column]], sigma: list[Column], offset: list[Column]) -> Column:
    """Squared distance in deviations of a point at ``offset`` from the centre."""
    local = [reduce(lambda a, b: a + b, [r[k][c] * offset[k] for k in range(3)]) / sigma[c] for c in range(3)]
    return local[0] * local[0] + local[1] * local[1] + local[2] * local[2]


def cell_key(grid, x: Column, y: Column, z: Column) -> Column:
    """Flat index of a cell."""
    return (z.cast("long") * grid.ny + y) * grid.nx + x


def quantize(v: Column) -> Column:
    """round(v * 1e6) as long, so that places further than 2147 from zero stay apart; saturating far beyond."""
    return F.greatest(F.lit(-(2.0**62)), F.least(F.lit(2.0**62), F.round(v * 1e6))).cast("long")


def clamp01(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def minus(a: list[Column], b: list[Column]) -> list[Column]:
    return [p - q for p, q in zip(a, b, strict=True)]


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]

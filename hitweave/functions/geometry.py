"""Scalar geometry and kinematics as JVM-side column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIMARY_BARCODE_LIMIT = 200000
TWO_PI = 2 * math.pi


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def radius(x, y) -> Column:
    x, y = col(x), col(y)
    return F.sqrt(x * x + y * y)


def azimuth(x, y) -> Column:
    return F.atan2(col(y), col(x))


def theta_to_eta(theta) -> Column:
    return -F.log(F.tan(col(theta) * 0.5))


def pseudorapidity(r, z) -> Column:
    return theta_to_eta(F.atan2(col(r), col(z)))


def distance(x, y, z, vx, vy, vz) -> Column:
    dx, dy, dz = col(x) - col(vx), col(y) - col(vy), col(z) - col(vz)
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def wrap_angle(angle) -> Column:
    """One pass of wrapping into [-pi, pi]."""
    a = col(angle)
    return F.when(a > math.pi, a - TWO_PI).when(a < -math.pi, a + TWO_PI).otherwise(a)


def primary_flag(barcode) -> Column:
    return (col(barcode) < PRIMARY_BARCODE_LIMIT).cast("int")


def transverse_momentum(px, py) -> Column:
    return radius(px, py)


def particle_eta(pt, pz) -> Column:
    pt, pz = col(pt), col(pz)
    return F.atanh(F.try_divide(pz, F.sqrt(pt * pt + pz * pz)))


def rotate(u, v, w, prefix: str = "rot_") -> tuple[Column, Column, Column]:
    """Module matrix times the local vector (u, v, w)."""
    u, v, w = col(u), col(v), col(w)
    return tuple(
        F.col(f"{prefix}{axis}u") * u + F.col(f"{prefix}{axis}v") * v + F.col(f"{prefix}{axis}w") * w
        for axis in "xyz"
    )


def spherical(x, y, z) -> tuple[Column, Column]:
    """(theta, phi) of a cartesian vector; theta is null for the zero vector."""
    x, y, z = col(x), col(y), col(z)
    r3 = F.sqrt(x * x + y * y + z * z)
    return F.acos(F.try_divide(z, r3)), F.atan2(y, x)


def safe_slope(numerator, denominator, limit: float = 100.0) -> Column:
    """Quotient with 0/0 and NaN -> 0, x/0 -> signed limit, clamped to the limit."""
    n, d = col(numerator), col(denominator)
    by_zero = F.when(n > 0, F.lit(limit)).when(n < 0, F.lit(-limit)).otherwise(F.lit(0.0))
    slope = F.when(d == 0, by_zero).otherwise(F.try_divide(n, d))
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), F.nanvl(slope, F.lit(0.0))))


def sigmoid(x) -> Column:
    return 1.0 / (1.0 + F.exp(-col(x)))


def decay_weight(distance_squared, strength: float, r: float) -> Column:
    return F.exp(-strength * col(distance_squared) / (r * r))


def schedule(points, epoch, max_epochs: int, integer: bool = False) -> Column:
    """Piecewise-linear value over an epoch column through 1, 2 or 3 points."""
    if not isinstance(points, (list, tuple)):
        return F.lit(points)
    e = col(epoch).cast("double")
    if len(points) == 2:
        value = points[0] + (points[1] - points[0]) * e / max_epochs
    elif len(points) == 3:
        half = max_epochs / 2
        rising = points[0] + (points[1] - points[0]) * e / half
        falling = points[1] + (points[2] - points[1]) * (e - half) / half
        value = F.when(e < half, rising).otherwise(falling)
    else:
        raise ValueError("a schedule has one, two or three points")
    return value.cast("int") if integer else value


def cluster_features(df: DataFrame, xyz: list[str], pixel: Column, prefix: str) -> DataFrame:
    """r, phi, eta of a cluster; pixel hits keep the hit's own r, phi and eta."""
    x, y, z = xyz
    out = df.withColumn(f"{prefix}r", F.when(pixel, F.col("r")).otherwise(radius(x, y)))
    return out.withColumns(
        {
            f"{prefix}phi": F.when(pixel, F.col("phi")).otherwise(azimuth(x, y)),
            f"{prefix}eta": F.when(pixel, F.col("eta")).otherwise(pseudorapidity(f"{prefix}r", z)),
        }
    )

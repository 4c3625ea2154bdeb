"""Points, rigid transforms and symmetric 3x3 eigenproblems as native expressions.

Matrices are row-major lists of nine numbers or columns. Everything is computed in double."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DEPTH_MM = 10_000


def depth_metres(d: Column) -> Column:
    """Millimetres to metres; null outside (0, 10 m]."""
    return F.when((d > 0) & (d <= MAX_DEPTH_MM), d / 1000.0)


def pixel_ray(idx: Column, width: int, z: Column) -> tuple[Column, Column, Column]:
    """Homogeneous ray of a pixel, (column * z, row * z, z); idx = row * width + column."""
    return (idx % width) * z, F.floor(idx / width) * z, z


def transform(m: list, p: tuple, t: list | None = None) -> tuple:
    """m p + t."""
    out = tuple(m[3 * i] * p[0] + m[3 * i + 1] * p[1] + m[3 * i + 2] * p[2] for i in range(3))
    return out if t is None else tuple(v + s for v, s in zip(out, t, strict=True))


def product(a: list, b: list) -> list:
    return [sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j]) for i in range(3) for j in range(3)]


def inverse(m: list) -> list:
    """By the adjugate; of columns, nulls for a singular matrix."""
    a, b, c, d, e, f, g, h, i = m
    cof = [e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d]
    det = a * cof[0] + b * cof[3] + c * cof[6]
    return [F.try_divide(x, det) if isinstance(det, Column) else x / det for x in cof]


def quaternion_matrix(x, y, z, w) -> list:
    return [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]


def dot(a: tuple, b: tuple) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: tuple, b: tuple) -> tuple:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def eigenvalues(s: tuple) -> tuple[Column, Column, Column]:
    """Ascending eigenvalues of the symmetric matrix (xx, xy, xz, yy, yz, zz), in closed form."""
    xx, xy, xz, yy, yz, zz = s
    q = (xx + yy + zz) / 3
    p = F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6)
    det = (xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)
    r = F.when(p > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2 * p * p * p)))).otherwise(0.0)
    angle = F.acos(r) / 3
    high = q + 2 * p * F.cos(angle)
    low = q + 2 * p * F.cos(angle + 2 * math.pi / 3)
    return low, 3 * q - high - low, high


def eigenvector(s: tuple, value: Column, otherwise: tuple) -> tuple:
    """Unit eigenvector of an eigenvalue: the longest cross product of two rows of S - value I;
    ``otherwise`` (an axis) where all vanish."""
    xx, xy, xz, yy, yz, zz = s
    rows = ((xx - value, xy, xz), (xy, yy - value, yz), (xz, yz, zz - value))
    candidates = [cross(rows[i], rows[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    sizes = [dot(c, c) for c in candidates]
    best = F.greatest(*sizes)
    pick = lambda k: F.when(sizes[0] == best, candidates[0][k]).when(sizes[1] == best, candidates[1][k]).otherwise(candidates[2][k])
    scale = xx + yy + zz
    return tuple(F.when(best > 1e-24 * F.pow(scale, 4), pick(k) / F.sqrt(best)).otherwise(F.lit(float(otherwise[k]))) for k in range(3))

"""Floor planes and the extrinsics that level them.

``consensus_plane`` finds the plane on which most points agree, whatever the others are:
hypotheses through three points each, drawn by a seeded hash, are scored on all points in one pass,
and the best is refitted on the points near it. ``fit_plane`` is plain least squares on points that
are mostly of the plane already."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxelflow.functions import geometry as g

from .lineage import cut


_MOMENTS = ("xx", "xy", "xz", "yy", "yz", "zz")


def _offset() -> Column:
    """How far the point x, y, z is from the plane nx, ny, nz, d."""
    return F.abs(F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z") + F.col("d"))


def least_squares(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, nx, ny, nz, d, inliers: the least-squares plane n . p + d = 0 of each group of 3 points or
    more, in one aggregation. The normal has y < 0."""
    n = F.count("*")
    stats = points.groupBy(*keys).agg(n.alias("inliers"), *[F.avg(c).alias(f"m{c}") for c in "xyz"], *[(F.covar_pop(p[0], p[1]) * n).alias(p) for p in _MOMENTS]).where("inliers >= 3")
    scatter = tuple(F.col(p) for p in _MOMENTS)
    stats = stats.withColumn("l0", g.eigenvalues(scatter)[0])
    v = g.eigenvector(scatter, F.col("l0"), (0, -1, 0))
    stats = stats.withColumns(dict(zip(("vx", "vy", "vz"), v, strict=True)))
    up = F.when(F.col("vy") > 0, -1.0).otherwise(1.0)
    stats = stats.withColumns({f"n{c}": F.col(f"v{c}") * up for c in "xyz"})
    return stats.select(*keys, "nx", "ny", "nz", (-(F.col("nx") * F.col("mx") + F.col("ny") * F.col("my") + F.col("nz") * F.col("mz"))).alias("d"), "inliers")


def fit_plane(points: DataFrame, keys: list[str], distance: float = 0.05, rounds: int = 3) -> DataFrame:
    """keys, nx, ny, nz, d, inliers: the least-squares plane of each group, refitted on the points
    within a distance that shrinks to ``distance``. One aggregation per round, whose row per group is
    checkpointed, so that rounds don't nest in one plan; groups of fewer than 3 points have no plane."""
    near, plane = points, None
    for k in range(rounds):
        plane = cut(least_squares(near, keys))
        if k + 1 < rounds:
            near = points.join(plane, keys).where(_offset() <= distance * 4.0 ** (rounds - 2 - k)).select(*points.columns)
    return plane


def hypotheses(points: DataFrame, keys: list[str], id: str, count: int = 200, axis: tuple[float, float, float] = (0.0, 1.0, 0.0), angle: float | None = 0.5, seed: int = 0) -> DataFrame:
    """keys, h, nx, ny, nz, d: planes through three points each, h from 0. Points stand in the order of
    md5("<seed>:<id>"), then of id and coordinates, the first 3 * count of a group are drawn, and three in a row make a
    plane; tasks keep their first ones before any shuffle. Left out: three points on a line, planes whose
    normal is more than ``angle`` (radians; None: any) from ``axis``. The normal has y <= 0."""
    rows = points.where("x is not null and y is not null and z is not null").select(*keys, "x", "y", "z", F.md5(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string"))).alias("_order"), F.col(id).alias("_id"))
    # the limit stands on the row number itself: only so does the planner set it before the shuffle too
    drawn = rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("_order", "_id", "x", "y", "z"))).where(F.col("_n") <= 3 * count).withColumn("_k", F.col("_n") - 1)
    at = lambda i: F.max(F.when(F.col("_k") % 3 == i, F.struct("x", "y", "z")))
    threes = drawn.groupBy(*keys, F.floor(F.col("_k") / 3).cast("int").alias("h")).agg(*[at(i).alias(c) for i, c in enumerate("abc")]).where("a is not null and b is not null and c is not null")
    first, second = (tuple(F.col(f"{p}.{c}") - F.col(f"a.{c}") for c in "xyz") for p in "bc")
    threes = threes.withColumns(dict(zip(("_u", "_v", "_w"), g.cross(first, second), strict=True)))
    threes = threes.withColumn("_size", F.sqrt(F.col("_u") * F.col("_u") + F.col("_v") * F.col("_v") + F.col("_w") * F.col("_w"))).where("_size > 1e-12")
    up = F.when(F.col("_v") > 0, -1.0).otherwise(1.0) / F.col("_size")
    threes = threes.withColumns({f"n{c}": F.col(f"_{k}") * up for c, k in zip("xyz", "uvw", strict=True)})
    size = math.sqrt(sum(a * a for a in axis))
    level = F.abs(sum((F.col(f"n{c}") * (a / size) for c, a in zip("xyz", axis, strict=True)), F.lit(0.0))) >= math.cos(angle) if angle is not None else F.lit(True)
    return threes.where(level).select(*keys, "h", "nx", "ny", "nz", (-(F.col("nx") * F.col("a.x") + F.col("ny") * F.col("a.y") + F.col("nz") * F.col("a.z"))).alias("d"))


def scores(points: DataFrame, planes: DataFrame, keys: list[str], distance: float = 0.05) -> DataFrame:
    """The planes with ``score``, how many points of their group lie within ``distance``. All are
    scored in one pass over the points; counts are summed in the tasks that read them."""
    planes = cut(planes)  # of known size: the planes go to the points, no group of points to one task
    met = points.select(*keys, "x", "y", "z").join(planes, keys).where(_offset() <= distance)
    counted = met.groupBy(*keys, "h").agg(F.count("*").alias("score"))
    return planes.join(counted, [*keys, "h"], "left").fillna(0, ["score"])


def consensus_plane(points: DataFrame, keys: list[str], id: str, distance: float = 0.05, count: int = 200, axis: tuple[float, float, float] = (0.0, 1.0, 0.0), angle: float | None = 0.5, seed: int = 0) -> DataFrame:
    """keys, nx, ny, nz, d, inliers: the plane most points agree on (ties: the smaller h), refitted on
    the points within ``distance`` of it; inliers: points within ``distance`` of the refitted plane.
    Groups without a hypothesis, or whose refitted plane leaves the axis, have no plane. ``id`` need not
    be unique: the draw is the same in every run."""
    planes = hypotheses(points, keys, id, count, axis, angle, seed)
    best = scores(points, planes, keys, distance).groupBy(*keys).agg(F.max_by(F.struct("nx", "ny", "nz", "d"), F.struct("score", -F.col("h"))).alias("v")).select(*keys, "v.*")
    best = cut(best)
    near = points.join(best, keys).where(_offset() <= distance).select(*keys, "x", "y", "z")
    refined = cut(least_squares(near, keys).drop("inliers"))
    size = math.sqrt(sum(a * a for a in axis))
    if angle is not None:
        refined = refined.where(F.abs(sum((F.col(f"n{c}") * (a / size) for c, a in zip("xyz", axis, strict=True)), F.lit(0.0))) >= math.cos(angle))
    counted = points.select(*keys, "x", "y", "z").join(refined, keys).where(_offset() <= distance).groupBy(*keys).agg(F.count("*").alias("inliers"))
    return refined.join(counted, keys)


def floor_points(points: DataFrame, label: int = 1) -> DataFrame:
    return points.where((F.col("label") == label) & F.col("x").isNotNull())


def extrinsics(plane: DataFrame) -> DataFrame:
    """Adds rotation (9, row-major), which turns the plane's up direction to +z, and translation
    (0, 0, height of the sensor above the plane)."""
    up = (F.col("nx"), F.col("ny"), F.col("nz"))
    ahead = (F.lit(0.0), F.lit(0.0), F.lit(1.0))
    flat = g.dot(ahead, up)
    y = tuple(a - flat * u for a, u in zip(ahead, up, strict=True))  # the camera's view, levelled
    size = F.sqrt(g.dot(y, y))
    y = tuple(F.when(size > 1e-9, v / size).otherwise(F.lit(float(i == 0))) for i, v in enumerate(y))
    x = g.cross(y, up)
    return plane.withColumns({"rotation": F.array(*x, *y, *up), "translation": F.array(F.lit(0.0), F.lit(0.0), F.abs(F.col("d")))})


def turned(rotation: Column, p: tuple) -> tuple:
    return g.transform([F.get(rotation, F.lit(i)) for i in range(9)], p)

"""Point clouds: from images, and from tables of observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelflow.functions import geometry as g


def zipped(images: list[DataFrame], keys: tuple[str, ...] = ("scene_id", "idx")) -> DataFrame:
    """Pixels that all images have, side by side by scene and place."""
    rows = images[0]
    for more in images[1:]:
        rows = rows.join(more, list(keys))
    return rows


def create_cloud(depth: DataFrame, color: DataFrame, label: DataFrame | None, calibration: DataFrame, rectified: bool = True) -> DataFrame:
    """scene_id, idx, x, y, z, r, g, b(, label): images zipped by (scene_id, idx) and back-projected.
    depth: scene_id, idx, width, d; color: scene_id, idx, r, g, b; calibration: resolved. Points
    without valid depth have null coordinates."""
    labels = [] if label is None else [label.select("scene_id", "idx", "label")]
    rows = zipped([depth.select("scene_id", "idx", "width", "d"), color.select("scene_id", "idx", "r", "g", "b"), *labels])
    rows = rows.join(calibration.select("scene_id", "k_inverse", "rigid", "t"), "scene_id")
    z = g.depth_metres(F.col("d"))
    ray = ((F.col("idx") % F.col("width")) * z, F.floor(F.col("idx") / F.col("width")) * z, z)
    at = lambda c, n: [F.get(F.col(c), F.lit(i)) for i in range(n)]
    p = g.transform(at("rigid", 9), ray, at("t", 3)) if rectified else g.transform(at("k_inverse", 9), ray)
    more = [] if label is None else ["label"]
    return rows.select("scene_id", "idx", *[v.alias(c) for v, c in zip(p, "xyz", strict=True)], "r", "g", "b", *more)


def origins(calibration: DataFrame, rectified: bool = True) -> DataFrame:
    """scene_id, ox, oy, oz: where the sensor stands."""
    return calibration.select("scene_id", *[(F.get("t", F.lit(i)) if rectified else F.lit(0.0)).alias(f"o{c}") for i, c in enumerate("xyz")])


def observations(table: DataFrame, waypoint_id: str, instance_number: int | None = None) -> DataFrame:
    """The cloud of a waypoint (and instance); the filter reaches the scan."""
    rows = table.where(F.col("waypoint_id") == waypoint_id)
    return rows if instance_number is None else rows.where(F.col("instance_number") == instance_number)


def with_origin(points: DataFrame, sensor: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ox, oy, oz; points without a known origin go, as the request fails without either."""
    return points.join(sensor.select(*keys, "ox", "oy", "oz"), keys)


def centred(points: DataFrame, back: bool = False) -> DataFrame:
    """Points relative to the origin ox, oy, oz, or back from there."""
    return points.withColumns({c: F.col(c) + F.col(f"o{c}") if back else F.col(c) - F.col(f"o{c}") for c in "xyz"})

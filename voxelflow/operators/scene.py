"""Whole flows over scenes: training rows from images, labelled clouds from requests, the published
fused cloud. Each composes the operators beside it into one plan; no step collects."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelflow.operators import crf, decode, forest, supervoxel, voxels
from voxelflow.operators.lineage import cut
from voxelflow.sources import clouds
from voxelflow.streaming import cache


def scene_tables(scenes: DataFrame, depth: DataFrame, color: DataFrame, label: DataFrame, calibration: DataFrame, rectified: bool = True) -> tuple[DataFrame, DataFrame]:
    """(cloud, origins) of the listed scenes: scene list, images and calibration joined by scene_id.
    A scene that lacks one of them gives no rows."""
    wanted = lambda rows: rows.join(scenes.select("scene_id").distinct(), "scene_id", "left_semi")
    camera = wanted(calibration)
    return clouds.create_cloud(wanted(depth), color, label, camera, rectified), clouds.origins(camera, rectified)


def members_of_image(cloud: DataFrame, ids: DataFrame) -> DataFrame:
    """The points that an id image (scene_id, idx, vid) puts in a supervoxel; id 0 is none."""
    return cloud.join(ids.where("vid > 0").select("scene_id", "idx", "vid"), ["scene_id", "idx"])


def jittered_supervoxels(cloud: DataFrame, jitters: tuple[float, ...], seed_resolution: float, resolution: float) -> tuple[DataFrame, DataFrame]:
    """(members, edges) with jitter_no: supervoxels of each scene for each jitter of the seed size.
    The jitters are a handful, so each is a plan of its own."""
    parts, edges = [], []
    for k, jitter in enumerate(jitters):
        points, touch, _ = supervoxel.supervoxels(cloud.withColumnRenamed("scene_id", "scene"), resolution, seed_resolution + jitter)
        parts.append(points.where("vid > 0").withColumnRenamed("scene", "scene_id").withColumn("jitter_no", F.lit(k)))
        edges.append(touch.withColumnRenamed("scene", "scene_id").withColumn("jitter_no", F.lit(k)))
    return cut(reduce(DataFrame.unionByName, parts)), cut(reduce(DataFrame.unionByName, edges))


def training_rows(members: DataFrame, keys: list[str], edges: DataFrame | None = None, min_points: int = 10, accumulate: bool = False, compat: bool = False) -> DataFrame:
    """keys, n, features, label of the supervoxels of all scenes (and jitters) that have
    ``min_points`` points and a majority label >= 0. members: keys (vid the last), x, y, z with a
    null where depth was invalid, r, g, b, label; keys hold jitter_no for ``accumulate``, which
    counts members of a jitter in all later ones too."""
    points = members.where("x is not null and y is not null and z is not null")
    if accumulate:
        points = decode.accumulate_jitters(points)
    large = voxels.keep_large(points, keys, min_points)
    labels = voxels.majority_label(large, keys).where("label >= 0")
    return voxels.features(large, keys, edges=edges, compat=compat).join(labels, keys)


def posterior_of_points(members: DataFrame, posterior: DataFrame, keys: list[str]) -> DataFrame:
    """Each point with its supervoxel's class probabilities (p)."""
    return members.join(posterior.select(*keys, F.col("prob").alias("p")), keys)


def valid_points(members: DataFrame, keys: list[str], scene: list[str], min_points: int = 10) -> DataFrame:
    """scene, n_points, n_voxels over the supervoxels that are large enough."""
    return voxels.at_least(members, keys, min_points).groupBy(*scene).agg(F.sum("n").alias("n_points"), F.count("*").alias("n_voxels"))


def smoothed(points: DataFrame, classes: int, appearance: float = 10.0, smoothness: float = 5.0, iterations: int = 2, method: str = "lattice") -> DataFrame:
    """Marginals of points scene, pidx, x, y, z, r, g, b, p: the CRF on scaled features."""
    f6, f3 = crf.scaled_features(tuple(F.col(c) for c in "xyz"), tuple(F.col(c) for c in "rgb"))
    return crf.mean_field(points.select("scene", "pidx", "p", f6.alias("f6"), f3.alias("f3")), classes, appearance, smoothness, iterations, method)


def label_cloud(members: DataFrame, model: RandomForestClassificationModel | DataFrame, classes: int, edges: DataFrame | None = None, min_points: int = 10, method: str = "lattice") -> tuple[DataFrame, DataFrame]:
    """A request answered for every waypoint at once: (labelled points, label frequencies).

    members: waypoint_id, vid, idx, x, y, z, r, g, b. Supervoxels below ``min_points`` go; features
    meet the model, or a table of posteriors (waypoint_id, vid, prob); each point takes its
    supervoxel's posterior, the CRF smooths it, and points are numbered by supervoxel and idx.
    Labelled points: waypoint_id, pidx, x, y, z, label, prob."""
    keys = ["waypoint_id", "vid"]
    large = voxels.keep_large(members, keys, min_points)
    found = model if isinstance(model, DataFrame) else forest.posterior(model, voxels.features(large, keys, edges=edges))
    points = cut(decode.point_index(posterior_of_points(large, found, keys), ["waypoint_id"], ["vid", "idx"]))  # read by each kernel
    q = smoothed(points.withColumnRenamed("waypoint_id", "scene"), classes, method=method).withColumnRenamed("scene", "waypoint_id")
    out = points.join(q, ["waypoint_id", "pidx"]).select("waypoint_id", "pidx", "x", "y", "z", decode.argmax(F.col("q")).alias("label"), F.col("q").alias("prob"))
    return out, decode.label_frequencies(out, ["waypoint_id"])


def respond(members: DataFrame, model: RandomForestClassificationModel | DataFrame, classes: int, **more) -> DataFrame:
    """One row per waypoint with the parallel arrays of the response."""
    return decode.response(*label_cloud(members, model, classes, **more))


def published(clouds_seen: DataFrame, order: list[str], key: str = "waypoint_id") -> DataFrame:
    """The fused cloud to publish: points (key, order.., frame_id, x, y, z, r, g, b) of the latest
    cloud of each key, under the frame of the most recent one; alpha and other columns are left
    out. All points of a cloud share their order, so the latest is a cloud and not a point."""
    marks = clouds_seen.select(key, *order, "frame_id").distinct()
    newest = cache.fused(cache.latest(marks, [key], order), order).select(key, *order, "fused_frame")
    return clouds_seen.join(newest, [key, *order]).select(key, "fused_frame", "x", "y", "z", "r", "g", "b")


def published_size(fused: DataFrame) -> DataFrame:
    """One row: n_points of the fused cloud."""
    return fused.agg(F.count("*").alias("n_points"))


def packed_fields(data: Column, offsets: dict[str, int], step: int, big_endian: bool = False) -> Column:
    """Array of structs of the points packed in ``data``: float32 at the offset of each of x, y, z
    and, where ``rgb`` is among them, r, g, b from its 32 bits. Native: bytes are cut and read as
    numbers, no Python."""
    n = F.floor(F.length(data) / step).cast("int")

    def word(at: Column, offset: int) -> Column:
        four = F.substring(data, at * step + offset + 1, 4)
        byte = lambda i: F.conv(F.hex(F.substring(four, i + 1, 1)), 16, 10).cast("long")
        parts = [byte(i) for i in (range(4) if big_endian else range(3, -1, -1))]
        return parts[0] * 16777216 + parts[1] * 65536 + parts[2] * 256 + parts[3]

    def number(w: Column) -> Column:
        sign = F.when(w >= 2147483648, -1.0).otherwise(1.0)
        power = F.shiftright(w, 23).bitwiseAND(255)
        part = w.bitwiseAND(8388607) / 8388608.0
        finite = F.when(power == 0, part * F.pow(F.lit(2.0), F.lit(-126.0))).otherwise((part + 1.0) * F.pow(F.lit(2.0), (power - 127).cast("double")))
        odd = F.when(part == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
        return sign * F.when(power == 255, odd).otherwise(finite)

    def point(at: Column) -> Column:
        found = [number(word(at, offsets[c])).alias(c) for c in "xyz"]
        if "rgb" in offsets:
            w = word(at, offsets["rgb"])
            found += [F.shiftright(w, s).bitwiseAND(255).cast("int").alias(c) for c, s in zip("rgb", (16, 8, 0), strict=True)]
        return F.struct(*found)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), point))


def unpacked(messages: DataFrame, keys: list[str], offsets: dict[str, int], step: int, big_endian: bool = False) -> DataFrame:
    """keys, idx, x, y, z(, r, g, b): one row per point of packed messages (column data). Messages
    without a whole point give no rows."""
    return messages.select(*keys, F.posexplode(packed_fields(F.col("data"), offsets, step, big_endian)).alias("idx", "p")).select(*keys, "idx", "p.*")

"""Whole flows over scenes against plain Python."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelflow.operators import scene
from voxelflow.sources import calibration


@pytest.mark.parametrize("big", [False, True])
def test_packed_points(spark, big):
    points = [(1.5, -2.25, 1e-3, (10, 20, 30)), (0.0, float("inf"), -1e30, (255, 0, 1)), (1e-40, 3.0, 7.0, (0, 0, 0))]
    way = ">" if big else "<"
    data = b"".join(struct.pack(way + "fffIf", x, y, z, r << 16 | g << 8 | b, 0.0) for x, y, z, (r, g, b) in points)
    rows = spark.createDataFrame([("w", bytearray(data)), ("cut", bytearray(data[:19])), ("none", None)], "waypoint_id string, data binary")
    got = scene.unpacked(rows, ["waypoint_id"], {"x": 0, "y": 4, "z": 8, "rgb": 12}, 20, big).orderBy("idx").collect()
    assert [r["waypoint_id"] for r in got] == ["w"] * 3
    want = [[float(np.float32(v)) for v in p[:3]] for p in points]
    assert np.allclose([[r["x"], r["y"], r["z"]] for r in got], want, rtol=1e-12, atol=0)
    assert [(r["r"], r["g"], r["b"]) for r in got] == [p[3] for p in points]


def _members(spark):
    rng = np.random.default_rng(2)
    rows = []
    for way in ("a", "b"):
        for vid in (1, 2, 3):
            for i in range(4 if vid == 3 else 12):
                rows.append((way, vid, i, *map(float, rng.normal(vid, 0.1, 3)), 10 * vid, 20, 30, vid % 2))
    return spark.createDataFrame(rows, "waypoint_id string, vid int, idx int, x double, y double, z double, r int, g int, b int, label int")


def test_response(spark):
    members = _members(spark)
    posterior = spark.createDataFrame([(w, v, [0.9, 0.1] if v == 1 else [0.2, 0.8]) for w in "ab" for v in (1, 2, 3)], "waypoint_id string, vid int, prob array<double>")
    rows = {r["waypoint_id"]: r for r in scene.respond(members, posterior, 2, method="exact").collect()}
    assert set(rows) == {"a", "b"}
    for r in rows.values():
        assert list(r["label"]) == [0] * 12 + [1] * 12  # the small supervoxel is gone, points by supervoxel and idx
        prob = np.array(r["label_probabilities"]).reshape(24, 2)
        assert np.allclose(prob.sum(1), 1) and np.allclose(prob.mean(0), r["label_frequencies"])
        assert len(r["points"]) == 24
    want = members.where("waypoint_id = 'a' and vid < 3").orderBy("vid", "idx").select("x", "y", "z").collect()
    assert [tuple(p) for p in rows["a"]["points"]] == [tuple(p) for p in want]
    totals = scene.valid_points(members, ["waypoint_id", "vid"], ["waypoint_id"]).collect()
    assert {(r["n_points"], r["n_voxels"]) for r in totals} == {(24, 2)}


def test_training_rows(spark):
    members = _members(spark).withColumn("x", F.when(F.col("idx") > 0, F.col("x")))
    got = scene.training_rows(members, ["waypoint_id", "vid"]).collect()
    assert {(r["waypoint_id"], r["vid"], r["n"], r["label"], len(r["features"])) for r in got} == {(w, v, 11, v % 2, 65) for w in "ab" for v in (1, 2)}
    assert scene.training_rows(members.where("false"), ["waypoint_id", "vid"]).count() == 0
    jittered = members.withColumn("jitter_no", F.lit(3))
    got = scene.training_rows(jittered, ["waypoint_id", "jitter_no", "vid"], accumulate=True).groupBy("jitter_no").count().collect()
    assert {(r["jitter_no"], r["count"]) for r in got} == {(3, 4), (4, 4)}


def test_published(spark):
    rows = [("a", 1, "old", 1.0), ("a", 2, "new", 2.0), ("a", 2, "new", 2.0), ("b", 3, "last", 3.0)]
    seen = spark.createDataFrame(rows, "waypoint_id string, ts int, frame_id string, x double").withColumns({"y": F.lit(0.0), "z": F.lit(0.0), "r": F.lit(1), "g": F.lit(2), "b": F.lit(3), "a": F.lit(255)})
    got = scene.published(seen, ["ts"])
    assert sorted((r["waypoint_id"], r["fused_frame"], r["x"]) for r in got.collect()) == [("a", "last", 2.0), ("a", "last", 2.0), ("b", "last", 3.0)]
    assert scene.published_size(got).head()[0] == 3 and "a" not in got.columns


def test_rectified_sibling(spark, tmp_path):
    raw = [("s", [2.0, 0.0, 1.0, 0.0, 4.0, 1.0, 0.0, 0.0, 1.0], ("m33", [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]), [0.0, 0.0, 1.5])]
    rows = calibration.resolve(spark.createDataFrame(raw, "scene_id string, intrinsic array<double>, rotation struct<format:string,data:array<double>>, translation array<double>"))
    there = calibration.write_rectified(rows, f"{tmp_path}/calibration/")
    assert there == f"{tmp_path}/calibration_rect"
    back = spark.read.text(there).head()
    assert back["scene_id"] == "s" and "m33" in back["value"]


def test_scene_tables(spark):
    """Listed scenes with all their images, in metres, with the sensor's place; the others give no rows."""
    grid = [(s, k, 4, 1) for s in ("a", "b", "c", "no label") for k in range(4)]
    depth = spark.createDataFrame([(*r, 1000 * r[1]) for r in grid], "scene_id string, idx long, width int, height int, d int")
    color = spark.createDataFrame([(s, k, 1, 2, 3) for s, k, *_ in grid], "scene_id string, idx long, r int, g int, b int")
    label = spark.createDataFrame([(s, k, k % 2) for s, k, *_ in grid if s != "no label"], "scene_id string, idx long, label int")
    camera = calibration.resolve(spark.createDataFrame([(s, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], ("m33", [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]), [0.0, 0.0, 2.0]) for s in ("a", "b", "no label")], "scene_id string, intrinsic array<double>, rotation struct<format:string,data:array<double>>, translation array<double>"))
    scenes = spark.createDataFrame([("a",), ("a",), ("c",), ("no label",), ("gone",)], "scene_id string")
    cloud, origins = scene.scene_tables(scenes, depth, color, label, camera)
    got = {(r["scene_id"], r["idx"]): (r["x"], r["y"], r["z"], r["label"]) for r in cloud.collect()}
    assert got == {("a", 0): (None, None, None, 0), ("a", 1): (1.0, 0.0, 3.0, 1), ("a", 2): (4.0, 0.0, 4.0, 0), ("a", 3): (9.0, 0.0, 5.0, 1)}
    assert {(r["scene_id"], r["oz"]) for r in origins.collect()} == {("a", 2.0), ("no label", 2.0)}


def test_jittered_supervoxels(spark):
    """Each jitter parts all points anew; edges join supervoxels of one jitter; rows to train on come for each."""
    rng = np.random.default_rng(4)
    rows = [("s", k, *map(float, rng.uniform(0, 1, 3) * [1, 1, 0.05]), 10, 20, 30, k % 2) for k in range(600)]
    cloud = spark.createDataFrame(rows, "scene_id string, idx long, x double, y double, z double, r int, g int, b int, label int")
    members, edges = scene.jittered_supervoxels(cloud, (-0.1, 0.0), 0.5, 0.1)
    found = {(r["jitter_no"], r["n"], r["v"]) for r in members.groupBy("jitter_no").agg(F.countDistinct("idx").alias("n"), F.countDistinct("vid").alias("v")).collect()}
    assert {(j, n) for j, n, _ in found} == {(0, 600), (1, 600)} and all(v > 3 for *_, v in found)
    held = members.select("jitter_no", F.col("vid").alias("src")).distinct()
    assert edges.join(held, ["jitter_no", "src"], "left_anti").count() == 0 and edges.where("src = dst").count() == 0
    trained = scene.training_rows(members, ["scene_id", "jitter_no", "vid"], edges=edges.select("scene_id", "jitter_no", "src", "dst"))
    assert {r["jitter_no"] for r in trained.select("jitter_no").distinct().collect()} == {0, 1} and len(trained.head()["features"]) == 128

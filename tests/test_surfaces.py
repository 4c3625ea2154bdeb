"""Consensus planes, voxel normals and the grid of a single camera."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelflow.operators import rectify, supervoxel

CLOUD = "scene int, idx long, x double, y double, z double, r int, g int, b int"


def cloud(spark, rows):
    return spark.createDataFrame([(s, k, *map(float, p), 1, 2, 3) for k, (s, p) in enumerate(rows)], CLOUD)


@pytest.mark.parametrize("tilt", [0.0, 0.2])
def test_consensus_with_outliers(spark, tilt):
    """A floor that holds 40 % of the points; the others fill the room, some of them on a wall."""
    rng = np.random.default_rng(1)
    n = 4000
    floor = rng.uniform(-2, 2, (n * 2 // 5, 3))
    floor[:, 1] = 1.5 + tilt * floor[:, 0] + rng.normal(0, 0.01, len(floor))
    wall = rng.uniform(-2, 2, (n // 5, 3))
    wall[:, 0] = -2 + rng.normal(0, 0.01, len(wall))
    rest = rng.uniform(-2, 2, (n - len(floor) - len(wall), 3))
    points = cloud(spark, [(0, p) for p in np.concatenate([floor, wall, rest])])
    found = rectify.consensus_plane(points, ["scene"], "idx", count=100).head()
    size = math.sqrt(1 + tilt**2)
    assert (found["nx"], found["ny"], found["nz"]) == pytest.approx((tilt / size, -1 / size, 0), abs=0.01)
    assert found["d"] == pytest.approx(1.5 / size, abs=0.01) and found["inliers"] >= len(floor) * 0.99
    plain = rectify.fit_plane(points, ["scene"]).head()
    assert abs(plain["d"] - 1.5 / size) > abs(found["d"] - 1.5 / size)


def test_consensus_axis(spark):
    """A wall with most of the points is no floor, unless any axis will do; a scene without a level plane has none."""
    rng = np.random.default_rng(2)
    wall, floor = rng.uniform(-1, 1, (300, 3)), rng.uniform(-1, 1, (150, 3))
    wall[:, 0], floor[:, 1] = 1, 0.5
    points = cloud(spark, [(0, p) for p in np.concatenate([wall, floor])] + [(1, p) for p in wall] + [(2, p) for p in wall[:2]])
    found = {r["scene"]: r for r in rectify.consensus_plane(points, ["scene"], "idx", count=60, angle=0.1).collect()}
    assert set(found) == {0} and found[0]["ny"] == pytest.approx(-1) and found[0]["inliers"] >= 150
    anyway = {r["scene"]: r for r in rectify.consensus_plane(points, ["scene"], "idx", count=60, angle=None).collect()}
    assert set(anyway) == {0, 1} and abs(anyway[0]["nx"]) == pytest.approx(1)


def test_scores_count_points(spark):
    rng = np.random.default_rng(3)
    points = cloud(spark, [(k % 2, p) for k, p in enumerate(rng.uniform(-1, 1, (200, 3)))] + [(0, (None,) * 3)][:0])
    planes = rectify.hypotheses(points, ["scene"], "idx", 10, angle=None)
    got = rectify.scores(points, planes, ["scene"], 0.2).collect()
    at = {s: np.array([(r["x"], r["y"], r["z"]) for r in points.where(F.col("scene") == s).collect()]) for s in (0, 1)}
    assert len(got) == 20
    for r in got:
        off = np.abs(at[r["scene"]] @ [r["nx"], r["ny"], r["nz"]] + r["d"])
        assert r["score"] == (off <= 0.2).sum() and (off < 1e-9).sum() == 3


def test_planes_shuffle_no_points(spark, tmp_path):
    """Tasks keep the points they draw before the shuffle, and planes are sent to the points."""
    rng = np.random.default_rng(6)
    points = cloud(spark, [(k % 2, p) for k, p in enumerate(rng.uniform(-1, 1, (4000, 3)))])
    points.repartition(2).write.parquet(str(tmp_path / "p"))
    points = spark.read.parquet(str(tmp_path / "p"))
    planes = rectify.hypotheses(points, ["scene"], "idx", 10, angle=None)
    plan = lambda rows: rows._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan(planes).split("Exchange", 1)[1]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")  # less than the points
    try:
        found = rectify.scores(points, planes, ["scene"], 0.2)
        whole = plan(found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Window [" not in whole and "Exchange hashpartitioning(scene#" not in "".join(x for x in whole.splitlines() if "h#" not in x)
    assert found.count() == 20


def test_normals(spark):
    """Normals of a floor and a wall, turned towards the sensor; none for lonely points."""
    rng = np.random.default_rng(4)
    floor, wall = rng.uniform(0, 1, (3000, 3)), rng.uniform(0, 1, (3000, 3))
    floor[:, 1], wall[:, 2] = 1.02, 3.02
    floor[:, 2] += 1
    points = cloud(spark, [(0, p) for p in np.concatenate([floor, wall])] + [(1, (5.0, 5.0, 5.0)), (1, (9.0, 9.0, 9.0))])
    v = supervoxel.voxel_grid(points, 0.1, scatter=True)
    got = supervoxel.voxel_normals(v, supervoxel.adjacency(v)).collect()
    assert len(got) == v.count()
    at = {(r["scene"], r["i"], r["j"], r["k"]): (r["nx"], r["ny"], r["nz"]) for r in got}
    assert at[0, 5, 10, 15] == pytest.approx((0, -1, 0), abs=1e-6) and at[0, 5, 5, 30] == pytest.approx((0, 0, -1), abs=1e-6)
    assert at[1, 50, 50, 50] == at[1, 90, 90, 90] == (None,) * 3


def test_normals_are_those_of_all_points(spark):
    """Merged moments against the points of the voxels within two steps, each read once."""
    rng = np.random.default_rng(5)
    xyz = rng.uniform(0, 1, (400, 3)) * [1, 1, 0.3] + [100, 100, 100]  # far from the origin
    v = supervoxel.voxel_grid(cloud(spark, [(0, p) for p in xyz]), 0.2, scatter=True)
    got = supervoxel.voxel_normals(v, supervoxel.adjacency(v)).collect()
    cell = np.floor(xyz / 0.2).astype(int)
    held = {tuple(c) for c in cell.tolist()}
    near = lambda a, b: max(abs(x - y) for x, y in zip(a, b, strict=True)) <= 1
    for r in got[:40]:
        own = (r["i"], r["j"], r["k"])
        first = {c for c in held if near(c, own)}
        reach = {c for c in held if any(near(c, f) for f in first)}
        p = xyz[[tuple(c) in reach for c in cell.tolist()]]
        value, vector = np.linalg.eigh(np.cov(p.T))
        if value[1] - value[0] > 1e-3 * value.sum():
            assert abs(np.dot(vector[:, 0], (r["nx"], r["ny"], r["nz"]))) == pytest.approx(1, abs=1e-6)


def test_normals_part_supervoxels(spark):
    """Two surfaces of one colour that meet: with normals, supervoxels cross the edge less."""
    rng = np.random.default_rng(6)
    floor, wall = rng.uniform(0, 0.93, (4000, 3)), rng.uniform(0, 0.93, (4000, 3))
    floor[:, 1], wall[:, 0] = 0.93, 0.93
    points = cloud(spark, [(0, p) for p in np.concatenate([floor, wall])])

    def mixed(normal):
        out, _, _ = supervoxel.supervoxels(points, 0.08, 0.25, normal=normal)
        sides = out.where("vid > 0").groupBy("vid").agg(F.avg((F.col("idx") < 4000).cast("double")).alias("p"), F.count("*").alias("n"))
        return sides.agg(F.sum(F.least("p", 1 - F.col("p")) * F.col("n"))).head()[0]

    assert mixed(3.0) < 0.7 * mixed(0.0)


def test_camera_grid(spark):
    """A wall near and a wall far, seen through the same pixels, fall into about as many cells."""
    rng = np.random.default_rng(7)
    rays = rng.uniform(-0.5, 0.5, (5000, 2))
    points = cloud(spark, [(k, (u * z, v * z, z)) for k, z in enumerate((1.0, 4.0)) for u, v in rays] + [(2, (0.1, 0.1, 0.0)), (2, (0.1, 0.1, -1.0))])
    points = points.union(spark.createDataFrame([(2, -1, None, None, None, 1, 2, 3)], CLOUD))
    size = {r["scene"]: r["n"] for r in supervoxel.voxel_grid(points.where("z > 0"), 0.05, camera=True).groupBy("scene").agg(F.count("*").alias("n")).collect()}
    even = {r["scene"]: r["n"] for r in supervoxel.voxel_grid(points.where("z > 0"), 0.05).groupBy("scene").agg(F.count("*").alias("n")).collect()}
    assert size[0] == size[1] and even[1] > 3 * even[0]
    out, edges, _ = supervoxel.supervoxels(points, 0.1, 0.3, camera=True)
    got = {r["scene"]: (r["n"], r["none"]) for r in out.groupBy("scene").agg(F.count("*").alias("n"), F.sum((F.col("vid") == 0).cast("int")).alias("none")).collect()}
    assert got[0][0] == got[1][0] == 5000 and got[2] == (3, 3)  # what the camera can't see keeps its row
    assert got[0][1] < 50 and edges.where("scene = 0").count() > 0

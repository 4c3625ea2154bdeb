"""Streams of clouds and requests, in several micro-batches."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelflow.operators import forest, voxels
from voxelflow.streaming import cache, service

ROW = "w string, ts int, no int, frame_id string, v double"


def arrive(spark, path, k, rows, schema=ROW):
    """One more file, later than those before."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    files = [f for f in os.listdir(path) if f.endswith(".parquet") and not os.path.exists(f"{path}/{f}.seen")]
    for f in files:
        os.utime(f"{path}/{f}", (1_700_000_000 + k, 1_700_000_000 + k))
        open(f"{path}/{f}.seen", "w").close()


def batches():
    rng = np.random.default_rng(0)
    return [[(f"w{rng.integers(0, 30)}" if i else None, int(rng.integers(0, 100)), 100 * k + i, f"f{k}.{i}", float(k)) for i in range(40)] for k in range(5)]


def newest(rows):
    best = {}
    for r in rows:
        if r[0] not in best or r[1:3] > best[r[0]][1:3]:
            best[r[0]] = r
    return best


def replay(spark, tmp_path, name, **more):
    source = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "in"))
    query = cache.keep_latest(source, ["w"], ["ts", "no"], str(tmp_path / "state"), str(tmp_path / name), buckets=8, **more)
    query.awaitTermination()
    assert query.exception() is None
    return query


def test_snapshots_of_five_batches(spark, tmp_path):
    parts = batches()
    for k, rows in enumerate(parts):
        arrive(spark, str(tmp_path / "in"), k, rows)
    replay(spark, tmp_path, "ck", snapshots=str(tmp_path / "out"), kept_snapshots=None)
    schema = spark.createDataFrame([], ROW).schema
    for k in range(5):
        want = newest(sum(parts[: k + 1], []))
        got = {r["w"]: r for r in spark.read.parquet(str(tmp_path / "out" / f"version={k}")).collect()}
        assert {w: tuple(r)[:5] for w, r in got.items()} == want
        assert {r["fused_frame"] for r in got.values()} == {max(want.values(), key=lambda r: r[1:3])[3]}
    assert {r["w"]: tuple(r) for r in cache.state(spark, str(tmp_path / "state"), schema).collect()} == newest(sum(parts, []))
    for bucket in (tmp_path / "state").glob("bucket=*"):
        found = list(bucket.glob("version=*"))
        assert 1 <= len(found) <= 2  # older versions are gone
        assert all(len(list(v.glob("*.parquet"))) == 1 for v in found)


def test_only_the_latest_snapshot_stays(spark, tmp_path):
    for k, rows in enumerate(batches()):
        arrive(spark, str(tmp_path / "in"), k, rows)
    replay(spark, tmp_path, "ck", snapshots=str(tmp_path / "out"), kept_snapshots=1)
    assert [p.name for p in (tmp_path / "out").glob("version=*")] == ["version=4"]


def test_fresh_checkpoint_adds_to_the_state(spark, tmp_path):
    parts = batches()
    for k, rows in enumerate(parts[:3]):
        arrive(spark, str(tmp_path / "in"), k, rows)
    replay(spark, tmp_path, "first")
    schema = spark.createDataFrame([], ROW).schema
    for f in (tmp_path / "in").glob("*.parquet"):
        f.unlink()
    arrive(spark, str(tmp_path / "in"), 3, [("w1", -5, 0, "old", 0.0), ("other", 1, 0, "new", 0.0)])
    replay(spark, tmp_path, "second")  # numbers its batches from 0 again
    want = newest(sum(parts[:3], []) + [("other", 1, 0, "new", 0.0)])
    assert {r["w"]: tuple(r) for r in cache.state(spark, str(tmp_path / "state"), schema).collect()} == want


def test_batch_that_runs_again(spark, tmp_path):
    rows = spark.createDataFrame(batches()[0], ROW)
    path = str(tmp_path / "state")
    for expected in (0, 1, 2):
        assert cache.upsert(rows, ["w"], ["ts", "no"], path, 4) == expected
        assert {r["w"]: tuple(r) for r in cache.state(spark, path, rows.schema).collect()} == newest(batches()[0])
    assert cache.upsert(rows.limit(0), ["w"], ["ts", "no"], path, 4) is None
    assert cache.state(spark, str(tmp_path / "nothing"), rows.schema).count() == 0


def test_untouched_buckets_are_not_rewritten(spark, tmp_path):
    path = str(tmp_path / "state")
    cache.upsert(spark.createDataFrame([(f"w{k}", 1, 0, "f", 0.0) for k in range(100)], ROW), ["w"], ["ts"], path, 16)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "state").rglob("*.parquet")}
    cache.upsert(spark.createDataFrame([("w5", 2, 0, "f", 1.0)], ROW), ["w"], ["ts"], path, 16)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "state").rglob("*.parquet")}
    assert before.items() <= after.items() and len(after) == len(before) + 1


def test_whole_clouds(spark, tmp_path):
    """A later cloud replaces all points of the earlier, also where it has fewer."""
    path = str(tmp_path / "state")
    first = [("a", 1, k, "f", float(k)) for k in range(5)] + [("b", 1, 0, "f", 0.0), (None, 1, 0, "f", 0.0)]
    cache.upsert(spark.createDataFrame(first, ROW), ["w"], ["ts"], path, 4, whole=True)
    cache.upsert(spark.createDataFrame([("a", 2, 0, "g", 9.0), ("a", 2, 1, "g", 8.0), ("b", 0, 7, "late", 0.0)], ROW), ["w"], ["ts"], path, 4, whole=True)
    got = sorted(((r["w"] or "", r["ts"], r["no"]) for r in cache.state(spark, path, spark.createDataFrame([], ROW).schema).collect()))
    assert got == [("", 1, 0), ("a", 2, 0), ("a", 2, 1), ("b", 1, 0)]


REQUEST = "request_id long, waypoint_id string, instance_number long"


def service_tables(spark):
    rng = np.random.default_rng(3)
    rows = []
    for way in ("a", "b", "no origin"):
        for instance in (1, 2):
            for vid in (1, 2):
                for k in range(20 if instance == 1 else 6):
                    rows.append((way, instance, vid, len(rows), *map(float, rng.normal(2 * vid, 0.1, 3)), 100 * vid, 20, 30))
    clouds = spark.createDataFrame(rows, "waypoint_id string, instance_number long, vid long, idx long, x double, y double, z double, r int, g int, b int")
    origins = spark.createDataFrame([("a", 0.0, 0.0, 0.0), ("b", 1.0, 0.0, 0.0), ("b", 1.0, 0.0, 0.0), ("no cloud", 0.0, 0.0, 0.0)], "waypoint_id string, ox double, oy double, oz double")
    return clouds, origins


REQUESTS = [(1, "a", None), (2, "a", 1), (3, "a", 2), (4, "a", 9), (5, "b", None), (6, "no origin", None), (7, "no cloud", None), (8, "nowhere", 1), (9, None, None)]
WANT = {1: ("ok", 52), 2: ("ok", 40), 3: ("no supervoxel", 0), 4: ("no cloud", 0), 5: ("ok", 52), 6: ("no origin", 0), 7: ("no cloud", 0), 8: ("no cloud", 0), 9: ("no cloud", 0)}


def test_outcomes(spark, tmp_path):
    clouds, origins = service_tables(spark)
    got = service.outcomes(spark.createDataFrame(REQUESTS, REQUEST), clouds, origins).collect()
    assert {r["request_id"]: (r["status"], r["n_points"]) for r in got} == WANT and len(got) == len(REQUESTS)
    for k, r in enumerate(REQUESTS):
        arrive(spark, str(tmp_path / "in"), k, [r], REQUEST)
    source = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 2).option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "in"))
    service.report_outcomes(source, clouds, origins, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r["request_id"]: (r["status"], r["n_points"]) for r in got} == WANT and len(got) == len(REQUESTS)


def test_serve_with_a_fitted_forest(spark, tmp_path):
    """The whole service: features, a fitted forest, the lattice CRF; good and failing requests in one stream."""
    clouds, origins = service_tables(spark)
    members = clouds.where("waypoint_id = 'a'").withColumn("vid", F.col("vid") * 10 + F.col("instance_number")).drop("waypoint_id")
    rows = voxels.features(members, ["vid"]).withColumn("label", (F.floor(F.col("vid") / 10) - 1).cast("int"))
    model = forest.fit(rows.select("features", "label").crossJoin(spark.range(30)), trees=9, depth=3, min_split=2)  # so many that each tree sees all four supervoxels
    for k, part in enumerate((REQUESTS[:4], [*REQUESTS[4:], (20, "nowhere", None)])):
        arrive(spark, str(tmp_path / "in"), k, part, REQUEST)
    source = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "in"))
    query = service.serve(source, clouds, origins, model, 2, str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination()
    assert query.exception() is None
    read = lambda what: spark.read.option("basePath", f"{tmp_path}/out/{what}").parquet(f"{tmp_path}/out/{what}").collect()
    assert {r["request_id"]: (r["status"], r["n_points"]) for r in read("outcomes")} == WANT | {20: ("no cloud", 0)}
    points = read("points")
    assert {i: sum(r["request_id"] == i for r in points) for i in (1, 2, 5)} == {1: 52, 2: 40, 5: 52} and len(points) == 144
    near = [r["label"] == int(r["y"] > 3) for r in points]
    assert np.mean(near) > 0.9
    shares = {(r["request_id"], r["label"]): r["freq"] for r in read("frequencies")}
    assert all(shares[i, 0] + shares[i, 1] == pytest.approx(1) for i in (1, 2, 5))

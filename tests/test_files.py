"""Image files as a data source, calibrations that go out and come back, and the scan from files to rows."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelflow.operators import scan
from voxelflow.sources import calibration, files, images
from voxelflow.sources.config import taxonomy

PIXEL = "scene_id string, idx long, width int, height int, values array<int>"


def pixel_rows(scene, image):
    height, width = image.shape[:2]
    return [(scene, k, width, height, [int(x) for x in v]) for k, v in enumerate(image.reshape(height * width, -1))]


@pytest.mark.parametrize(("channels", "depth", "top"), [(3, 8, 255), (1, 8, 255), (1, 16, 65535)])
def test_png_round_trip(spark, tmp_path, channels, depth, top):
    rng = np.random.default_rng(depth + channels)
    pictures = {s: rng.integers(0, top, (n, n + 3, channels), endpoint=True) for s, n in (("a", 5), ("b b", 70), ("c.d", 1))}
    rows = [r for s, x in pictures.items() for r in pixel_rows(s, x)]
    path = str(tmp_path / "png")
    files.write_images(spark.createDataFrame(rows, PIXEL).repartition(4), path, depth=depth)
    assert sorted(os.listdir(path)) == ["a.png", "b b.png", "c.d.png"]
    assert all((images.decode_png((tmp_path / "png" / f"{s}.png").read_bytes()) == x).all() for s, x in pictures.items())
    assert sorted(tuple(r) for r in files.read_images(spark, path).collect()) == sorted(rows)


def test_matrix_round_trip(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(s, k, 40, 30, rng.normal(0, 1, 2).tolist()) for s in "ab" for k in range(1200)]
    path = str(tmp_path / "m")
    files.write_images(spark.createDataFrame(rows, PIXEL.replace("array<int>", "array<double>")), path, "matrix")
    assert sorted(tuple(r) for r in files.read_images(spark, path, "matrix").collect()) == rows
    monkeypatch.setattr(files, "RANGE_BYTES", 40 * 16 * 7)
    parts = files._Reader(path, "matrix").partitions()
    assert [(p.start, p.stop) for p in parts[:5]] == [(0, 7), (7, 14), (14, 21), (21, 28), (28, 30)] and len(parts) == 10
    got = [r for p in parts for b in files._Reader(path, "matrix").read(p) for r in zip(*(b.column(c).to_pylist() for c in ("scene_id", "idx", "width", "height", "values")), strict=True)]
    assert got == rows  # each range reads its own rows


def test_aborted_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "png")
    good = pixel_rows("a", np.zeros((3, 3, 1), int))
    with pytest.raises(Exception, match="do not fill"):
        files.write_images(spark.createDataFrame(good + pixel_rows("b", np.zeros((3, 3, 1), int))[:-1], PIXEL), path)
    assert not os.path.exists(path) or os.listdir(path) == []
    files.write_images(spark.createDataFrame(good, PIXEL), path)
    with pytest.raises(Exception, match="do not fill"):
        files.write_images(spark.createDataFrame(good[:-1], PIXEL), path, mode="overwrite")
    assert os.listdir(path) == ["a.png"]  # what was there stays
    files.write_images(spark.createDataFrame(pixel_rows("z", np.ones((2, 2, 1), int)), PIXEL), path, mode="overwrite")
    assert os.listdir(path) == ["z.png"]


def test_scene_in_two_tasks_is_an_error(spark, tmp_path):
    files.register(spark)
    rows = spark.createDataFrame(pixel_rows("a", np.zeros((1, 1, 1), int)) * 2, PIXEL).repartition(2)
    with pytest.raises(Exception, match="two tasks|do not fill"):
        rows.write.format(files.NAME).mode("append").save(str(tmp_path / "png"))
    assert not os.path.exists(tmp_path / "png") or os.listdir(tmp_path / "png") == []


CALIBRATION = {"intrinsic": [10.0, 0, 4, 0, 10.0, 3, 0, 0, 1], "rotation": {"format": "q4", "data": [0.0, 0.0, 0.0, 1.0]}, "translation": [0, 0, 1.5], "name": 'say "hi"', "n": 3, "more": {"x": [1, None, True]}}


def test_rectified_calibrations_come_back(spark, tmp_path):
    """Written with a new rotation and read by scene again; other keys are kept."""
    (tmp_path / "cal").mkdir()
    for s in ("a", "b c"):
        (tmp_path / "cal" / f"{s}.json").write_text("// a camera\n" + json.dumps(CALIBRATION))
    rows = calibration.read(spark, str(tmp_path / "cal"))
    turned = rows.withColumn("rotation", F.array(*[F.lit(float(v)) for v in (0, -1, 0, 1, 0, 0, 0, 0, 1)])).withColumn("t", F.array(F.lit(0.0), F.lit(0.0), F.lit(2.5)))
    there = calibration.write_rectified(turned, str(tmp_path / "cal"))
    back = {r["scene_id"]: r for r in calibration.read(spark, there).collect()}
    assert set(back) == {"a", "b c"}
    for r in back.values():
        assert r["rotation"] == [0, -1, 0, 1, 0, 0, 0, 0, 1] and r["t"] == [0, 0, 2.5] and r["k"] == CALIBRATION["intrinsic"]
        kept = json.loads(r["text"])
        assert {k: kept[k] for k in ("name", "n", "more")} == {k: CALIBRATION[k] for k in ("name", "n", "more")} and kept["rotation"]["format"] == "m33"


COLORS = [{"name": "void", "label": -1, "color": [0, 0, 0]}, {"name": "left", "label": 0, "color": [10, 0, 0]}, {"name": "right", "label": 1, "color": [0, 20, 0]}]
ENDINGS = {"depth": ".png", "color": ".png", "label": ".png", "calibration": ".json", "voxel": ".png"}


def folders_of(tmp_path, scenes):
    """Scenes of 12 x 8 pixels: the left half labelled 0, the right half 1, four supervoxels, one pixel without depth."""
    folders = {k: str(tmp_path / k) for k in scan.KINDS}
    for f in folders.values():
        os.makedirs(f, exist_ok=True)
    x, y = np.meshgrid(np.arange(12), np.arange(8))
    for s in scenes:
        depth = (1000 + 10 * x + y).astype(np.uint16)
        depth[0, 0] = 0
        color = np.stack([x * 10, y * 10, x + y], 2).astype(np.uint8)
        label = np.where(x[..., None] < 6, [10, 0, 0], [0, 20, 0]).astype(np.uint8)
        vid = 1 + (x >= 6) + 2 * (y >= 4)
        for kind, data in (("depth", depth), ("color", color), ("label", label)):
            with open(f"{folders[kind]}/{s}.png", "wb") as f:
                f.write(images.encode_png(data))
        with open(f"{folders['calibration']}/{s}.json", "w") as f:
            json.dump(CALIBRATION, f)
        yield s, vid, folders


def test_files_to_rows(spark, tmp_path):
    """From PNG files to training rows, and on from where a scan stopped."""
    entries = taxonomy(spark, COLORS)
    made = list(folders_of(tmp_path, ["s1", "s2", "s3", "extra"]))
    folders = made[0][2]
    for s, vid, _ in made:  # supervoxel images through the writer
        grid = spark.createDataFrame([(s, k, 12, 8) for k in range(96)], "scene_id string, idx long, width int, height int")
        members = spark.createDataFrame([(s, k, int(v)) for k, v in enumerate(vid.reshape(-1)) if k != 95], "scene_id string, idx long, vid int")
        files.write_images(files.id_images(grid, members), folders["voxel"])
    os.remove(f"{folders['label']}/s3.png")
    wanted = scan.scene_sets(spark, [("test", ["s2", "gone"]), ("train", ["s1", "s2", "s3"])])
    assert {(r["scene_id"], r["scene_set"]) for r in wanted.collect()} == {("s2", "test"), ("gone", "test"), ("s1", "train"), ("s3", "train")}
    out = str(tmp_path / "out")
    assert scan.scan(spark, wanted, folders, ENDINGS, entries, out, group=1) == ["s2", "s1"]  # test before train
    status = {r["scene_id"]: (r["status"], r["missing"]) for r in spark.read.parquet(f"{out}/report").collect()}
    assert status == {"s1": ("complete", ""), "s2": ("complete", ""), "s3": ("incomplete", "label"), "gone": ("incomplete", ",".join(scan.KINDS)), "extra": ("unlisted", "")}
    rows = {(r["scene_id"], r["vid"]): r for r in spark.read.parquet(f"{out}/rows").collect()}
    assert {k: (r["n"], r["label"], len(r["features"])) for k, r in rows.items()} == {(s, v): (n, l, 65) for s in ("s1", "s2") for v, n, l in ((1, 23, 0), (2, 24, 1), (3, 24, 0), (4, 23, 1))}
    before = {f: os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(f"{out}/rows") for f in names}
    assert scan.scan(spark, wanted, folders, ENDINGS, entries, out) == []
    list(folders_of(tmp_path, ["s3"]))  # the missing file comes
    assert scan.scan(spark, wanted, folders, ENDINGS, entries, out) == ["s3"]
    after = {f: os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(f"{out}/rows") for f in names}
    assert all(after[f] == t for f, t in before.items() if f.startswith("part-"))  # finished scenes are as they were
    assert spark.read.parquet(f"{out}/rows").where("scene_id = 's3'").count() == 4


def test_report_of_odd_rows(spark):
    found = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "y"), ("c", "other"), (None, "x")], "scene_id string, kind string")
    wanted = spark.createDataFrame([("a",), ("a",), ("b",), ("d",)], "scene_id string")
    got = sorted((r["scene_id"] or "", r["status"], r["missing"]) for r in scan.report(wanted, found, ["x", "y"]).collect())
    assert got == [("", "unlisted", "y"), ("a", "complete", ""), ("b", "incomplete", "x"), ("d", "incomplete", "x,y")]


def test_label_images(spark, tmp_path):
    entries = taxonomy(spark, COLORS)
    grid = spark.createDataFrame([("s", k, 3, 1) for k in range(3)], "scene_id string, idx long, width int, height int")
    labels = spark.createDataFrame([("s", 0, 1), ("s", 2, 0)], "scene_id string, idx long, label int")
    files.write_images(files.label_images(grid, labels, entries), str(tmp_path / "l"))
    assert images.decode_png((tmp_path / "l" / "s.png").read_bytes()).tolist() == [[[0, 20, 0], [0, 0, 0], [10, 0, 0]]]
    assert {r["idx"]: r["label"] for r in images.load_label(spark, str(tmp_path / "l"), entries).collect()} == {0: 1, 1: -1, 2: 0}

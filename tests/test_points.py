"""Hand-computed values of the point operators."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelflow.functions import codec
from voxelflow.functions import geometry as g
from voxelflow.operators import crf, decode, forest, rectify, supervoxel, voxels
from voxelflow.sources import calibration, clouds, images
from voxelflow.sources.config import Config, colors_to_labels, frequency_report, label_names, parse_arguments, parse_json, taxonomy, taxonomy_counts
from voxelflow.streaming import cache

BOX = [(1.0, 0.0, 0.0), (-1.0, 0.0, 0.0), (0.0, 2.0, 0.0), (0.0, -2.0, 0.0), (0.0, 0.0, 3.0), (0.0, 0.0, -3.0)]


def box(spark, vid=1):
    return spark.createDataFrame([(vid, *p, 10, 100, 200) for p in BOX], "vid int, x double, y double, z double, r int, g int, b int")


def test_majority(spark):
    rows = [(1, v) for v in (3, 3, 2, 2, -1, -1, -1)] + [(2, -1)]
    got = voxels.majority_label(spark.createDataFrame(rows, "vid int, label int"), ["vid"]).collect()
    assert {r["vid"]: r["label"] for r in got} == {1: 2, 2: -1}
    spaces = [(1, "image", -1), (1, "voxel", 4), (2, "voxel", 4)]
    got = voxels.majority_of_spaces(spark.createDataFrame(spaces, "vid int, space string, label int"), ["vid"]).collect()
    assert {r["vid"]: r["label"] for r in got} == {1: -1, 2: 4}


def test_codec(spark):
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 8, 16777215)], "id int")
    r, gr, b = codec.segment_id_to_rgb(F.col("id"))
    rows = ids.select("id", r.alias("r"), gr.alias("g"), b.alias("b"), codec.rgb_to_segment_id(r, gr, b).alias("back")).collect()
    assert [(x["r"], x["g"], x["b"]) for x in rows] == [(128, 0, 0), (0, 128, 0), (128, 128, 0), (64, 0, 0), (255, 255, 255)]
    assert all(x["id"] == x["back"] for x in rows)


def test_depth(spark):
    got = spark.createDataFrame([(d,) for d in (0, 1, 999, 1000, 10000, 10001, 65535)], "d int").select(g.depth_metres(F.col("d")).alias("m")).collect()
    assert [r["m"] for r in got] == [None, 0.001, 0.999, 1.0, 10.0, None, None]


@pytest.mark.parametrize(("data", "want"), [([1.0, 0, 0, 0, 1, 0, 0, 0, 1], (2, 2, 3.5)), ([0.0, 1, 0, -1, 0, 0, 0, 0, 1], (-2, 2, 3.5))])
def test_back_projection(spark, data, want):
    camera = spark.createDataFrame([("s", [2.0, 0.0, 1.0, 0.0, 4.0, 1.0, 0.0, 0.0, 1.0], ("m33", [float(v) for v in data]), [9.0, 9.0, 1.5])], "scene_id string, intrinsic array<double>, rotation struct<format:string,data:array<double>>, translation array<double>")
    camera = calibration.resolve(camera)
    depth = spark.createDataFrame([("s", 53, 10, 2000)], "scene_id string, idx long, width int, d int")
    color = spark.createDataFrame([("s", 53, 1, 2, 3)], "scene_id string, idx long, r int, g int, b int")
    p = clouds.create_cloud(depth, color, None, camera).head()
    assert (p["x"], p["y"], p["z"]) == want
    raw = clouds.create_cloud(depth, color, None, camera, rectified=False).head()
    assert (raw["x"], raw["y"], raw["z"]) == (2, 2, 2)
    assert tuple(clouds.origins(camera).head())[1:] == (0, 0, 1.5)
    assert parse_json(camera.select(calibration.to_json(camera)).head()[0])["rotation"]["data"] == data


def test_bad_rotation(spark):
    rows = spark.createDataFrame([("s", [1.0] * 9, ("euler", [1.0] * 9), [0.0] * 3)], "scene_id string, intrinsic array<double>, rotation struct<format:string,data:array<double>>, translation array<double>")
    with pytest.raises(Exception, match="rotation format"):
        calibration.resolve(rows).collect()


def test_histogram(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0, 17, 0), (1, 0.0, 0.0, 0.0, 255, 34, 0)], "vid int, x double, y double, z double, r int, g int, b int")
    intended = voxels.statistics(p, ["vid"]).head()
    assert {i: intended[f"h{i}"] / 2 for i in range(51) if intended[f"h{i}"]} == {0: 0.5, 15: 0.5, 18: 0.5, 19: 0.5, 34: 1.0}
    literal = voxels.statistics(p, ["vid"], compat=True).head()
    assert {i: literal[f"h{i}"] / 2 for i in range(51) if literal[f"h{i}"]} == {0: 0.5, 15: 0.5, 17: 2.0}


def test_shape_and_features(spark):
    f = voxels.features(box(spark), ["vid"], (-5.0, 0.0, 0.0)).head()["features"]
    assert len(f) == 65
    assert f[52:56] == pytest.approx([2, 6, 10, 1 / 14])
    assert f[56:60] == pytest.approx([1, 0, 0, math.pi / 2])
    assert (f[60], abs(f[61])) == pytest.approx((0, 0.6))
    assert f[62:65] == pytest.approx([2, 4, 6])


def test_neighbours(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3)], "src int, dst int")
    f = voxels.features(box(spark), ["vid"], (-5.0, 0.0, 0.0), edges, compat=True).head()["features"]
    assert len(f) == 128
    assert f[117:120] == pytest.approx([4, 12, 10])
    assert f[120:128] == pytest.approx([0] * 8, abs=1e-6)
    two = box(spark, 1).union(box(spark, 2).withColumn("x", F.col("x") + 4)).union(box(spark, 3))
    both = voxels.features(two, ["vid"], edges=spark.createDataFrame([(1, 2)], "src int, dst int"))
    rows = {r["vid"]: r for r in both.collect()}
    assert rows[1]["has_neighbors"] and not rows[3]["has_neighbors"]
    x = np.array([*BOX, *[(a + 4, b, c) for a, b, c in BOX]])
    l_ = np.linalg.eigvalsh((x - x.mean(0)).T @ (x - x.mean(0)))
    assert rows[1]["features"][117:119] == pytest.approx([l_[0] - 2, (l_[1] - l_[0]) - 6])


def test_decode(spark):
    p = spark.createDataFrame([(0, [0.2, 0.8]), (0, [0.6, 0.4]), (1, [0.4, 0.4])], "scene int, prob array<double>")
    assert [r[0] for r in p.select(decode.argmax(F.col("prob"))).collect()] == [1, 0, 0]
    freq = {r["label"]: r["freq"] for r in decode.label_frequencies(p.where("scene = 0"), ["scene"]).collect()}
    assert freq == pytest.approx({0: 0.4, 1: 0.6})


def test_jitters(spark):
    m = spark.createDataFrame([(7, 0, 1), (7, 0, 2), (7, 1, 3)], "vid int, jitter_no int, idx int")
    got = decode.accumulate_jitters(m, 2).groupBy("jitter_no").agg(F.sort_array(F.collect_list("idx")).alias("i")).collect()
    assert {r["jitter_no"]: r["i"] for r in got} == {0: [1, 2], 1: [1, 2, 3]}


def _crf_points(spark, n=40):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([1, 1], n)
    return spark.createDataFrame([(0, i, p[i].tolist(), rng.normal(size=6).tolist(), rng.normal(size=3).tolist()) for i in range(n)], "scene int, pidx int, p array<double>, f6 array<double>, f3 array<double>")


def test_crf(spark):
    points = _crf_points(spark)
    same = crf.mean_field(points, 2, 0.0, 0.0).join(points, "pidx").collect()
    assert all(r["q"] == pytest.approx(r["p"]) for r in same)
    exact = {r["pidx"]: r["q"] for r in crf.mean_field(points, 2, 0.0, 1.0, method="exact").collect()}
    near = {r["pidx"]: r["q"] for r in crf.mean_field(points, 2, 0.0, 1.0, method="grid").collect()}
    assert all(sum(q) == pytest.approx(1) for q in exact.values())
    assert np.mean([abs(exact[k][0] - near[k][0]) for k in exact]) < 0.03


@pytest.mark.parametrize("block", [5, 4096])
def test_exact_messages_of_any_blocks(spark, monkeypatch, block):
    """Sums over all pairs, whatever the blocks: repeated points, nulls, lonely points, one far from all."""
    monkeypatch.setattr(crf, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows = [(k % 2, int(k % 37), rng.dirichlet([1, 1]).tolist(), rng.normal(size=3).tolist()) for k in range(80)]
    rows += [(0, 90, [0.5, None], [0.1, 0.2, 0.3]), (0, 91, None, [0.3, 0.2, 0.3]), (1, 92, [0.5, 0.5], [0.1, None, 0.3]), (1, 93, [0.5, 0.5], None), (2, 94, [0.5, 0.5], [0.0] * 3)]
    rows += [(0, None, [0.5, 0.5], [0.0] * 3), (None, 1, [0.5, 0.5], [0.0] * 3), (3, 95, [0.2, 0.8], [0.0] * 3), (3, 96, [0.2, 0.8], [1e3] * 3), (4, 97, [math.nan, 1.0], [0.0] * 3), (4, 98, [0.25, 0.75], [1.0] * 3)]
    want = {}
    for scene, i, _, f in rows:
        for other, j, p, g in rows:
            if None not in (scene, i, j) and scene == other and i != j:
                w = want.setdefault((scene, i), [[], [], [], []])
                if f and g and None not in (*f, *g):
                    k = math.exp(-0.5 * sum((x - y) ** 2 for x, y in zip(f, g, strict=True)))
                    w[2].append(k)
                    for c in (0, 1):
                        if p and p[c] is not None:
                            w[c].append(k * p[c])
    got = {(r["scene"], r["pidx"]): (r["m0"], r["m1"]) for r in crf.kernel_messages(spark.createDataFrame(rows, "scene int, pidx int, q array<double>, f array<double>"), "f", 2).collect()}
    assert set(got) == set(want) and (2, 94) not in got and got[1, 92] == got[1, 93] == (None, None)
    for key, (*sums, k, _) in want.items():
        for c in (0, 1):
            if not sums[c]:
                assert got[key][c] is None
            else:
                assert got[key][c] == pytest.approx(math.fsum(sums[c]) / math.fsum(k) if math.fsum(k) else math.nan, rel=1e-12, nan_ok=True)


def test_supervoxels_part_the_cloud(spark):
    rng = np.random.default_rng(2)
    p = spark.createDataFrame([(0, i, *map(float, rng.uniform(0, 0.6, 3)), 1, 2, 3) for i in range(400)], "scene int, idx int, x double, y double, z double, r int, g int, b int")
    out, edges, _ = supervoxel.supervoxels(p, 0.1, 0.2)
    assert out.count() == 400 and out.select("idx").distinct().count() == 400
    assert edges.where("src = dst").count() == 0 and edges.count() == edges.join(edges.toDF("scene", "dst", "src"), ["scene", "src", "dst"]).count()


def test_plane(spark):
    rng = np.random.default_rng(3)
    p = spark.createDataFrame([(0, float(a), 1.5 + float(e), float(b)) for a, b, e in zip(rng.uniform(-2, 2, 300), rng.uniform(-2, 2, 300), rng.normal(0, 0.005, 300), strict=True)], "scene int, x double, y double, z double")
    found = rectify.extrinsics(rectify.fit_plane(p, ["scene"])).withColumn("up", F.array(*rectify.turned(F.col("rotation"), (F.col("nx"), F.col("ny"), F.col("nz"))))).head()
    assert (found["nx"], found["ny"], found["nz"]) == pytest.approx((0, -1, 0), abs=0.02) and found["d"] == pytest.approx(1.5, abs=0.02)
    assert found["up"] == pytest.approx([0, 0, 1], abs=1e-9)


def test_taxonomy(spark):
    entries = taxonomy(spark, [{"name": "a", "label": 0, "color": [1, 1, 1]}, {"name": "b", "label": 0, "color": [2, 2, 2]}, {"name": "void", "label": -1, "color": [0, 0, 0]}])
    assert label_names(entries) == ["b"]
    pixel = spark.createDataFrame([(9, 9, 9)], "r int, g int, b int")
    with pytest.raises(Exception, match="not in the taxonomy"):
        colors_to_labels(pixel, entries).collect()
    assert colors_to_labels(pixel, entries, unknown=-1).head()["label"] == -1


def test_config(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"a": 1, // one\n "b": 2, "u": "http://x"}')
    c = Config.read(spark, str(tmp_path / "c.json"), {"b": "3", "w": "word"})
    assert (c.get("a", int), c.get("b", int), c.get("u"), c.get("w"), c.get("z", int, 5)) == (1, 3, "http://x", "word", 5)
    with pytest.raises(KeyError):
        c.get("z")
    assert parse_arguments(["--a", "1", "--a", "2"]) == {"a": "2"} and parse_arguments(["a", "1"]) is None
    with pytest.raises(ValueError):
        parse_arguments(["--a"])


def test_config_of_files(spark, tmp_path):
    """A value from the file that a key names, and scene lists."""
    (tmp_path / "more.json").write_text('{"extra": 7, "other": 1}')
    (tmp_path / "c.json").write_text(f'{{"root_dir": "{tmp_path}/", "extra": "more.json", "train": ["s1", "s2"]}}')
    c = Config.read(spark, str(tmp_path / "c.json"))
    assert c.from_file(spark, "extra", int) == 7 and c.path("extra") == f"{tmp_path}/more.json"
    assert [r["scene_id"] for r in c.scenes(spark, "train").collect()] == ["s1", "s2"]


def test_observations(spark):
    rows = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 1.0), ("b", 1, 2.0)], "waypoint_id string, instance_number int, x double")
    assert clouds.observations(rows, "a").count() == 2 and clouds.observations(rows, "a", 2).head()["x"] == 1.0
    assert clouds.observations(rows, "c").count() == 0


def test_forest_is_saved(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(int(v[0] > 0), v.tolist()) for v in rng.normal(0, 1, (200, 4))], "label int, features array<double>")
    model = forest.fit(rows, trees=5, depth=4, min_split=4)
    forest.save(model, str(tmp_path / "m"))
    one, two = (forest.posterior(m, rows).select("prob").collect() for m in (model, forest.load(str(tmp_path / "m"))))
    assert one == two and np.mean([r["prob"][1] > 0.5 for r in one]) == pytest.approx(rows.agg({"label": "avg"}).head()[0], abs=0.1)


def test_features_of_null_keys(spark):
    """A null scene and a null voxel are groups like others, with neighbours."""
    rng = np.random.default_rng(6)
    rows = [(s, v, *map(float, rng.normal(0, 1, 3)), 1, 2, 3) for s, v in ((None, 1), (None, 2), (0, None), (0, 1)) for _ in range(12)]
    points = spark.createDataFrame(rows, "scene int, vid int, x double, y double, z double, r int, g int, b int")
    edges = spark.createDataFrame([(None, 1, 2), (None, 2, 1), (0, 1, None)], "scene int, src int, dst int")
    got = {(r["scene"], r["vid"]): r for r in voxels.features(points, ["scene", "vid"], edges=edges).collect()}
    assert set(got) == {(None, 1), (None, 2), (0, None), (0, 1)} and all(r["n"] == 12 for r in got.values())
    assert {k: r["has_neighbors"] for k, r in got.items()} == {(None, 1): True, (None, 2): True, (0, None): False, (0, 1): True}
    plain = {(r["scene"], r["vid"]): r["features"] for r in voxels.features(points, ["scene", "vid"]).collect()}
    assert all(r["features"][:65] == pytest.approx(plain[k]) for k, r in got.items())
    assert voxels.keep_large(points, ["scene", "vid"], 12).count() == 48


def test_images(spark, tmp_path):
    depth = np.array([[0, 1, 999], [1000, 10000, 10001]], np.uint16)
    (tmp_path / "s1.png").write_bytes(images.encode_png(depth))
    got = images.load_depth(spark, str(tmp_path / "s1.png")).orderBy("idx").collect()
    assert [r["d"] for r in got] == depth.ravel().tolist() and got[0]["scene_id"] == "s1"
    values = np.arange(12, dtype=np.float32).reshape(2, 3, 2)
    (tmp_path / "m.bin").write_bytes(images.encode_matrix(values))
    assert [r["values"] for r in images.load_matrix(spark, str(tmp_path / "m.bin")).orderBy("idx").collect()] == values.reshape(-1, 2).tolist()
    rgb = spark.createDataFrame([("a", i, 2, 2, [i, 2 * i, 255]) for i in range(4)], "scene_id string, idx long, width int, height int, rgb array<int>")
    back = images.decode_png(bytes(images.write_png(rgb).head()["content"]))
    assert back.reshape(-1, 3).tolist() == [[i, 2 * i, 255] for i in range(4)]


def test_cache(spark):
    rows = spark.createDataFrame([("w1", 1, "a"), ("w2", 2, "b"), ("w1", 3, "c")], "w string, ts int, v string")
    state = cache.latest(rows, ["w"], ["ts"])
    assert {r["w"]: r["v"] for r in state.collect()} == {"w1": "c", "w2": "b"}
    assert {r["fused_frame"] for r in cache.fused(state, ["ts"], "v").collect()} == {"c"}


def test_stream_replay(spark, tmp_path):
    for k, v in enumerate("abc"):
        spark.createDataFrame([("w1", k, v), (f"x{k}", k, v)], "w string, ts int, v string").write.parquet(str(tmp_path / "in" / f"f{k}"))
    source = spark.readStream.schema("w string, ts int, v string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    cache.keep_latest(source, ["w"], ["ts"], str(tmp_path / "state"), str(tmp_path / "ck")).awaitTermination()
    assert {r["w"]: r["v"] for r in cache.state(spark, str(tmp_path / "state"), source.schema).collect()} == {"w1": "c", "x0": "a", "x1": "b", "x2": "c"}


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_png_filters(channels):
    """Rows of all five filters, coded here byte by byte."""
    rng = np.random.default_rng(channels)
    image = rng.integers(0, 256, (12, 7, channels)).astype(int)
    flat, lines = image.reshape(12, -1), []
    for y in range(12):
        kind, line = y % 5, [y % 5]
        for x in range(flat.shape[1]):
            a = flat[y, x - channels] if x >= channels else 0
            b = flat[y - 1, x] if y else 0
            c = flat[y - 1, x - channels] if y and x >= channels else 0
            paeth = sorted((abs(a + b - c - v), k, v) for k, v in enumerate((a, b, c)))[0][2]
            line.append((flat[y, x] - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        lines.append(bytes(map(int, line)))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", 7, 12, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
    assert (images.decode_png(png) == image).all()


def test_supervoxel_ids_and_lost_points(spark):
    rows = [(s, float(x), float(y), 0.5, 1, 2, 3, "own") for s in (1, 2) for x in range(8) for y in range(8)] + [(1, None, 1.0, 1.0, 1, 2, 3, "own")]
    frame = spark.createDataFrame(rows, "scene int, x double, y double, z double, r int, g int, b int, i string")
    got = supervoxel.supervoxels(frame, 1.0, 4.0)[0].collect()
    assert len(got) == len(rows) and all(r["i"] == "own" for r in got)
    assert [r["vid"] for r in got if r["x"] is None] == [0]
    for s in (1, 2):
        ids = {r["vid"] for r in got if r["scene"] == s and r["x"] is not None}
        assert ids == set(range(1, len(ids) + 1))


def test_reports(spark):
    entries = taxonomy(spark, [{"name": "a", "label": 0, "color": [1, 1, 1]}, {"name": "b", "label": 0, "color": [2, 2, 2]}, {"name": "void", "label": -1, "color": [0, 0, 0]}])
    assert tuple(taxonomy_counts(entries).head()) == (3, 1)
    assert [r["line"] for r in frequency_report(spark.createDataFrame([(0, 0.25)], "label int, freq double"), entries).collect()] == ["b : 0.25"]

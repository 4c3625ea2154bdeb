"""The registered queries: each operator applied to the driver's tables seen as clouds.

lineitem stands for points (voxel: supplier), events for labelled points, embeddings for points
with features. SQL holds the same results in DuckDB's dialect; values are rounded in both."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelflow.functions import codec
from voxelflow.functions import geometry as g
from voxelflow.operators import crf, crf_learning, decode, density, forest, importance, lattice, rectify, scan, scene, supervoxel, voxels
from voxelflow.operators.lineage import shared_folder
from voxelflow.sources import clouds, files
from voxelflow.sources.config import colors_to_labels, frequency_report, labels_to_colors, overlaid, taxonomy, taxonomy_counts
from voxelflow.streaming import cache, service

CLASSES = {"signup": 0, "purchase": 1, "click": 2, "view": 3, "error": -1}
ENTRIES = [
    {"name": "joined", "label": 0, "color": [10, 20, 30]}, {"name": "signup", "label": 0, "color": [11, 21, 31]}, {"name": "purchase", "label": 1, "color": [40, 50, 60]},
    {"name": "click", "label": 2, "color": [70, 80, 90]}, {"name": "view", "label": 3, "color": [100, 110, 120]}, {"name": "error", "label": -1, "color": [0, 0, 0]},
]
_LABEL = "CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE -1 END"
_PC = "SELECT l_suppkey AS vid, l_quantity AS x, l_discount * 100 AS y, l_extendedprice / 1000 AS z, CAST(l_partkey % 256 AS INT) AS r, CAST(l_orderkey % 256 AS INT) AS g, CAST((l_partkey + l_orderkey) % 256 AS INT) AS b FROM lineitem"
_ENTRIES = ", ".join(f"({i}, '{e['name']}', {e['label']}, {e['color'][0]}, {e['color'][1]}, {e['color'][2]})" for i, e in enumerate(ENTRIES))
#: A camera.
K, TURN, SHIFT = [2.0, 0.0, 1.0, 0.0, 4.0, 1.0, 0.0, 0.0, 1.0], [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0], [0.0, 0.0, 1.5]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("vid"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_extendedprice") / 1000).alias("z"),
        (F.col("l_partkey") % 256).cast("int").alias("r"), (F.col("l_orderkey") % 256).cast("int").alias("g"), ((F.col("l_partkey") + F.col("l_orderkey")) % 256).cast("int").alias("b"),
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.lit(-1)
    for name, k in CLASSES.items():
        label = F.when(F.col("event_type") == name, k).otherwise(label)
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("vid"), "event_id", "ts", "value", "event_type", "props", label.cast("int").alias("label"))


def _rounded(*columns: str, digits: int = 3) -> list[Column]:
    return [F.round(F.col(c), digits).alias(c) for c in columns]


def majority_class_distribution(spark, sf_dir):
    e = _events(spark, sf_dir)
    major = voxels.majority_label(voxels.keep_large(e, ["vid"], 10), ["vid"])
    return labels_to_colors(forest.class_distribution(major), taxonomy(spark, ENTRIES)).select("label", "name", "n")


def taxonomy_last_wins(spark, sf_dir):
    rows = _events(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))
    return labels_to_colors(rows, taxonomy(spark, ENTRIES)).select("label", "name", "r", "g", "b", "n")


def strict_label_lookup(spark, sf_dir):
    entries = taxonomy(spark, ENTRIES)
    e = _events(spark, sf_dir).withColumn("name", F.col("event_type"))
    colored = e.drop("label").join(F.broadcast(entries.select("name", "r", "g", "b")), "name")
    found = colors_to_labels(colored, entries).withColumn("key", codec.color_key(F.col("r"), F.col("g"), F.col("b")))
    return found.groupBy("key", "label").agg(F.count("*").alias("n"))


def depth_validity_filter(spark, sf_dir):
    d = (F.col("l_extendedprice") - 2000).cast("int")
    rows = _table(spark, sf_dir, "lineitem").select("l_suppkey", g.depth_metres(d).alias("m"))
    return rows.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count("m").alias("valid"), F.round(F.sum("m"), 3).alias("metres"))


def backproject_rigid(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("idx"), (F.col("l_extendedprice") / 100).cast("int").alias("d"))
    z = g.depth_metres(F.col("d"))
    ray = g.pixel_ray(F.col("idx"), 64, z)
    inv = g.inverse(K)
    raw, rigid = g.transform(inv, ray), g.transform(g.product(TURN, inv), ray, SHIFT)
    named = rows.select("l_suppkey", *[v.alias(f"u{c}") for c, v in zip("xyz", raw, strict=True)], *[v.alias(f"p{c}") for c, v in zip("xyz", rigid, strict=True)])
    return named.groupBy("l_suppkey").agg(*[F.round(F.avg(c), 7).alias(c) for c in ("ux", "uy", "uz", "px", "py", "pz")])


def center_uncenter(spark, sf_dir):
    origin = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("vid"), (F.col("s_acctbal") / 1000).alias("ox"), F.col("s_nationkey").cast("double").alias("oy"), F.lit(1.0).alias("oz"))
    there = clouds.centred(clouds.with_origin(_points(spark, sf_dir), origin, ["vid"]))
    back = clouds.centred(there.withColumns({f"c{c}": F.col(c) for c in "xyz"}), back=True)
    return back.groupBy("vid").agg(*[F.round(F.avg(c), 7).alias(f"mean_{c}") for c in ("cx", "cy", "cz", "x", "y", "z")])


def rgb_to_lab(spark, sf_dir):
    p = _points(spark, sf_dir)
    lab = codec.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    rows = p.select("vid", *[v.alias(c) for v, c in zip(lab, ("light", "a_star", "b_star"), strict=True)])
    return rows.groupBy("vid").agg(*[F.round(F.avg(c), 1).alias(c) for c in ("light", "a_star", "b_star")])


def segment_id_codec(spark, sf_dir):
    p = F.col("p_partkey").cast("int")
    r, gr, b = codec.segment_id_to_rgb(p)
    return _table(spark, sf_dir, "part").select("p_partkey", r.alias("r"), gr.alias("g"), b.alias("b"), codec.rgb_to_segment_id(r, gr, b).alias("back"))


def voxel_group_size_having(spark, sf_dir):
    return voxels.at_least(_points(spark, sf_dir).where("vid > 0"), ["vid"], 590)


def voxel_centroid(spark, sf_dir):
    return _points(spark, sf_dir).groupBy("vid").agg(*[F.round(F.avg(c), 7).alias(f"m{c}") for c in "xyz"])


def _histogram(spark, sf_dir, compat):
    stats = voxels.statistics(_points(spark, sf_dir), ["vid"], compat)
    return stats.select("vid", *[F.round(F.col(f"h{i}") / F.col("n"), 8).alias(f"h{i}") for i in range(51)])


def voxel_color_histogram_intended(spark, sf_dir):
    return _histogram(spark, sf_dir, False)


def voxel_color_histogram_compat(spark, sf_dir):
    return _histogram(spark, sf_dir, True)


_S = ("xx", "xy", "xz", "yy", "yz", "zz")


def voxel_scatter_matrix(spark, sf_dir):
    found = voxels.statistics(_points(spark, sf_dir), ["vid"])
    # per point: the plain sums can lie just between two rounded values, and the order of adding then decides
    return found.select("vid", "n", *[F.round(F.col(k) / F.col("n"), 6).alias(k) for k in _S])


def voxel_eigen_shape(spark, sf_dir):
    s = voxels.shape(voxels.statistics(_points(spark, sf_dir), ["vid"]))
    return s.select("vid", *_rounded("sigma_p", "sigma_s", "sigma_l", digits=2), *_rounded("curvature", digits=6))


def voxel_normal_bbox(spark, sf_dir):
    p = _points(spark, sf_dir)
    s = voxels.shape(voxels.statistics(p, ["vid"]), (0.0, 0.0, 0.0))
    both = s.join(voxels.extents(p, s, ["vid"]), "vid")
    return both.select("vid", *_rounded("nx", "ny", "nz", digits=4), *_rounded("bb1", "bb2", "bb3"))


def _edges(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"))
    near = s.select("src", F.explode(F.array(F.col("src") - 1, F.col("src") + 1)).alias("dst"))
    return near.join(s.withColumnRenamed("src", "dst"), "dst").select("src", "dst")


def _neighbors(spark, sf_dir, compat):
    f = voxels.features(_points(spark, sf_dir), ["vid"], edges=_edges(spark, sf_dir), compat=compat)
    at = lambda i, d: F.round(F.get("features", F.lit(i)), d).alias(f"f{i}")
    return f.select("vid", "n", "has_neighbors", *[at(i, 3) for i in (0, 54, 65)], *[at(i, 5) for i in (1, 40, 66, 105)], *[at(i, 1) for i in (117, 118, 119)], *[at(i, 6) for i in (120,)])


def neighbor_features_intended(spark, sf_dir):
    return _neighbors(spark, sf_dir, False)


def neighbor_features_compat(spark, sf_dir):
    return _neighbors(spark, sf_dir, True)


#: Digits of each feature: histograms, eigenvalues, curvature, normal, angles and boxes.
_DIGITS = [3, *[8] * 51, 1, 1, 1, 6, *[4] * 4, 4, 4, 3, 3, 3]


def neighbor_features_all(spark, sf_dir):
    """All 128 features of each voxel, a row each."""
    f = voxels.features(_points(spark, sf_dir), ["vid"], edges=_edges(spark, sf_dir))
    digits = [*_DIGITS, _DIGITS[0], *_DIGITS[1:56], 4, *_DIGITS[59:65]]
    each = F.array(*[F.round(F.get("features", F.lit(i)), d) for i, d in enumerate(digits)])
    return f.select("vid", F.posexplode(each).alias("i", "v"))


def image_semi_join(spark, sf_dir):
    good = _table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("vid"))
    return decode.existing_only(_points(spark, sf_dir), good, ["vid"]).groupBy("vid").agg(F.count("*").alias("n"))


def pixel_zip_join(spark, sf_dir):
    depth = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.col("label").alias("d"))
    label = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"), "quality")
    return clouds.zipped([depth, label], ("idx",)).groupBy("d", "quality").agg(F.count("*").alias("n"), F.sum("idx").alias("sum_idx"))


def scatter_default(spark, sf_dir):
    grid = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"))
    value = _table(spark, sf_dir, "events").groupBy((F.col("user_id") * 7).alias("idx")).agg(F.count("*").alias("label"))
    return decode.scatter_default(grid, value, ["idx"], {"label": -1})


def jitter_expand(spark, sf_dir):
    e = decode.jitter_expand(_events(spark, sf_dir))
    return e.groupBy("jitter_no", F.round("seed_resolution", 3).alias("seed_resolution"), "label").agg(F.count("*").alias("n"))


def jitter_accumulate_compat(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("jitter_no", (F.col("event_id") % 5).cast("int"))
    return decode.accumulate_jitters(e).groupBy("jitter_no", "vid").agg(F.count("*").alias("n"))


def point_index(spark, sf_dir):
    return decode.point_index(_events(spark, sf_dir), ["label"], ["vid", "event_id"]).select("label", "event_id", F.col("pidx").cast("long").alias("pidx"))


def _slices(spark, sf_dir) -> DataFrame:
    """scene (10 labels), pidx, logits in three components, their softmax p, scaled features."""
    e = _table(spark, sf_dir, "embeddings")
    v = lambda i: F.get("embedding", F.lit(i)).cast("double")
    raw = [F.exp(v(10 + i) * 4) for i in range(3)]
    total = raw[0] + raw[1] + raw[2]
    return e.select(F.col("label").alias("scene"), F.col("vec_id").alias("pidx"), F.array(*[r / total for r in raw]).alias("p"), F.array(*[v(i) * 4 for i in range(6)]).alias("f6"), F.array(*[v(i) * 8 for i in range(3)]).alias("f3"))


def argmax_decode(spark, sf_dir):
    return _slices(spark, sf_dir).select("pidx", decode.argmax(F.col("p")).alias("label"))


def label_frequencies(spark, sf_dir):
    f = decode.label_frequencies(_slices(spark, sf_dir), ["scene"], "p")
    return f.select("scene", F.col("label").cast("int").alias("label"), F.round("freq", 6).alias("freq"))


def unary_energy(spark, sf_dir):
    e = decode.unary_energy(F.col("p"))
    return _slices(spark, sf_dir).select("pidx", *[F.round(F.get(e, F.lit(i)), 5).alias(f"u{i}") for i in range(3)])


def crf_gaussian_messages(spark, sf_dir):
    m = crf.kernel_messages(_slices(spark, sf_dir), "f3", 3, "p")
    return m.select("scene", "pidx", *_rounded("m0", "m1", "m2", digits=5))


def _marginals(spark, sf_dir):
    return crf.mean_field(_slices(spark, sf_dir), 3, 2.0, 1.0, 2, "exact")


def crf_mean_field_2iter(spark, sf_dir):
    return _marginals(spark, sf_dir).select("scene", "pidx", *[F.round(F.get("q", F.lit(i)), 4).alias(f"q{i}") for i in range(3)])


def crf_map(spark, sf_dir):
    return crf.map_labels(_marginals(spark, sf_dir))


def crf_grid(spark, sf_dir):
    found = crf.mean_field(_slices(spark, sf_dir), 3, 0.0, 1.0, 2, "grid")
    return found.select("scene", "pidx", *[F.round(F.get("q", F.lit(i)), 4).alias(f"q{i}") for i in range(3)])


def crf_lattice_splat(spark, sf_dir):
    """What each vertex of the smoothness kernel's lattice receives."""
    corners = lattice.simplex(_slices(spark, sf_dir), "f3", 3)
    return lattice.splat(corners, [F.get("p", F.lit(i)) for i in range(3)], 3).select("scene", *lattice.coordinates(3), *_rounded("n", "v0", "v1", "v2", digits=5))


def crf_lattice_messages(spark, sf_dir):
    m = crf.messages(_slices(spark, sf_dir), "f6", 3, 6, q="p")
    return m.select("scene", "pidx", *_rounded("m0", "m1", "m2", digits=4))


def crf_lattice(spark, sf_dir):
    """Marginals with both kernels in linear time."""
    found = crf.mean_field(_slices(spark, sf_dir), 3, 2.0, 1.0, 2)
    return found.select("scene", "pidx", *[F.round(F.get("q", F.lit(i)), 4).alias(f"q{i}") for i in range(3)])


def crf_gradient(spark, sf_dir):
    """Log likelihood of labels, and its gradient by kernel weights and compatibility, where learning starts."""
    points = _slices(spark, sf_dir).withColumn("label", (F.col("pidx") % 4 - 1).cast("int"))
    found, by_weight, by_pair, n = crf_learning.likelihood(crf_learning.with_messages(points, 3), np.array([2.0, 1.0]), np.eye(3))
    row = {"n": n, "l": found, "w0": by_weight[0], "w1": by_weight[1]} | {f"c{i}{j}": by_pair[i, j] for i in range(3) for j in range(3)}
    return spark.createDataFrame([(n, *[round(float(v), 5) for k, v in row.items() if k != "n"])], "n long, " + ", ".join(f"{k} double" for k in row if k != "n"))


def importance_swaps(spark, sf_dir):
    """Whose values held-out rows get for each of five columns, and how often that changes them."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "label", F.slice(F.col("embedding").cast("array<double>"), 1, 5).alias("features"))
    each = importance.swapped(rows.where(importance.held_out("vec_id")), "vec_id", 5)
    own = F.get("features", F.col("c"))
    return each.groupBy("c").agg(F.count("*").alias("n"), F.sum((F.col("value") != own).cast("long")).alias("changed"), F.countDistinct("donor").alias("donors"), F.sum(F.col("donor") * (F.col("id") % 7)).alias("mark"))


def cloud_divergence(spark, sf_dir):
    """Divergence of the points of the first labels from those of the others, in three components."""
    p = _slices(spark, sf_dir).select("scene", "pidx", *[F.get("f3", F.lit(i)).alias(c) for i, c in enumerate("xyz")])
    return density.divergence(p.where("scene < 5"), p.where("scene >= 5"), 1.0, "pidx").select("n", F.round("kl", 6).alias("kl"))


def rf_train_predict(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"), "label")
    model = forest.fit(rows)
    return forest.posterior(model, rows).select("vec_id", "label", decode.argmax(F.col("prob")).alias("predicted"))


def _scened(spark, sf_dir):
    return _points(spark, sf_dir).withColumn("scene", F.lit(0))


def supervoxel_grid(spark, sf_dir):
    v = supervoxel.voxel_grid(_scened(spark, sf_dir), 5.0)
    return v.select("scene", "i", "j", "k", "n", *_rounded("x", "y", "z", "r", digits=7))


def supervoxel_adjacency(spark, sf_dir):
    a = supervoxel.adjacency(supervoxel.voxel_grid(_scened(spark, sf_dir), 5.0))
    return a.groupBy("scene", "i", "j", "k").agg(F.count("*").alias("neighbours"))


def supervoxel_full(spark, sf_dir):
    p, edges, _ = supervoxel.supervoxels(_scened(spark, sf_dir), 5.0, 10.0)
    degree = edges.groupBy("src").agg(F.count("*").alias("degree")).withColumnRenamed("src", "vid")
    return p.groupBy("vid").agg(F.count("*").alias("n")).join(degree, "vid", "left")


def voxel_normals(spark, sf_dir):
    """The normal of each voxel, from the moments of the voxels around it."""
    v = supervoxel.voxel_grid(_scened(spark, sf_dir), 5.0, scatter=True)
    found = supervoxel.voxel_normals(v, supervoxel.adjacency(v))
    return found.select("scene", "i", "j", "k", *_rounded("nx", "ny", "nz"))


def supervoxel_camera_grid(spark, sf_dir):
    """The cells of a single camera, and each point's distance from its cell's mean depth."""
    p = _scened(spark, sf_dir)
    v = supervoxel.voxel_grid(p, 0.25, camera=True)
    near = p.select("z", *supervoxel.cells(0.25, True)).join(v.select("i", "j", "k", F.col("z").alias("mz")), ["i", "j", "k"])
    back = near.groupBy("i", "j", "k").agg(F.max(F.abs(F.col("z") - F.col("mz"))).alias("depth"))
    # times n: the means themselves can lie just between two rounded values, and the order of adding then decides
    return v.join(back, ["i", "j", "k"]).select("scene", "i", "j", "k", "n", *[F.round(F.col(c) * F.col("n"), 5).alias(c) for c in ("x", "y", "z", "depth")])


def supervoxel_camera(spark, sf_dir):
    """Supervoxels of a single camera's cloud: sizes, and points that no supervoxel holds (vid 0)."""
    p, edges, _ = supervoxel.supervoxels(_scened(spark, sf_dir), 0.25, 1.0, camera=True)
    degree = edges.groupBy("src").agg(F.count("*").alias("degree")).withColumnRenamed("src", "vid")
    return p.groupBy("vid").agg(F.count("*").alias("n")).join(degree, "vid", "left")


def plane_fit(spark, sf_dir):
    p = _points(spark, sf_dir).withColumn("y", F.col("y") / 100)
    found = rectify.extrinsics(rectify.fit_plane(p, ["vid"], 0.05))
    return found.select("vid", "inliers", *_rounded("nx", "ny", "nz", "d", digits=4))


#: Hypotheses of a plane in the queries, and how near a point must be; no distance between the given points is just that.
_PLANES, _NEAR = 20, 0.0512345


def _identified(spark, sf_dir) -> DataFrame:
    """Points of ten scenes with ids, nearly level."""
    p = _table(spark, sf_dir, "lineitem")
    return p.select((F.col("l_suppkey") % 10).alias("vid"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), (F.col("l_extendedprice") / 1000).alias("z"))


def plane_hypotheses(spark, sf_dir):
    """Planes through three drawn points of a scene, and how many of its points agree with each."""
    p = _identified(spark, sf_dir)
    found = rectify.scores(p, rectify.hypotheses(p, ["vid"], "idx", _PLANES), ["vid"], _NEAR)
    return found.select("vid", "h", *_rounded("nx", "ny", "nz", "d", digits=6), "score")


def plane_consensus(spark, sf_dir):
    found = rectify.consensus_plane(_identified(spark, sf_dir), ["vid"], "idx", _NEAR, _PLANES)
    return found.select("vid", *_rounded("nx", "ny", "nz", "d", digits=5), "inliers")


def minmax_rescale(spark, sf_dir):
    s = decode.rescale(_table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice")
    return s.select("p_partkey", F.round("scaled", 4).alias("scaled"))


def fused_latest_by_waypoint(spark, sf_dir):
    e = _events(spark, sf_dir).select("vid", "ts", "event_id", F.col("event_type").alias("frame_id"), "value")
    state = cache.fused(cache.latest(e, ["vid"], ["ts", "event_id"]), ["ts", "event_id"])
    return state.select("vid", "event_id", "value", "fused_frame")


def _run(spark: SparkSession, what: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark)}/{what}-{spark.sparkContext.applicationId}-{spark._jvm.java.util.UUID.randomUUID()}"


def stream_cache_replay(spark, sf_dir):
    """Events as a stream of files; the state after the last micro-batch."""
    run = _run(spark, "stream")
    batch = _table(spark, sf_dir, "events")
    source = spark.readStream.schema(batch.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*.parquet")
    rows = source.select(F.col("user_id").alias("vid"), "ts", "event_id", "event_type", "value")
    cache.keep_latest(rows, ["vid"], ["ts", "event_id"], f"{run}/state", f"{run}/checkpoint").awaitTermination()
    return cache.state(spark, f"{run}/state", rows.schema).select("vid", "event_id", "value")


def stream_cache_snapshots(spark, sf_dir):
    """Events arriving in five batches, by the remainder of event_id; the cache as published after each."""
    run, files = _run(spark, "stream"), 4
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("vid"), "ts", "event_id", F.col("event_type").alias("frame_id"), "value")
    for k in range(5):  # one after another: a stream takes files in the order of their times
        rows.where(F.col("event_id") % 5 == k).repartition(files).write.mode("append").parquet(f"{run}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{run}/in")
    cache.keep_latest(source, ["vid"], ["ts", "event_id"], f"{run}/state", f"{run}/checkpoint", buckets=16, snapshots=f"{run}/published", kept_snapshots=None).awaitTermination()
    found = spark.read.option("basePath", f"{run}/published").parquet(f"{run}/published")
    return found.select(F.col("version").cast("int").alias("version"), "vid", "event_id", "value", "fused_frame")


def _service_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(clouds, origins): a supplier is a waypoint, a line number an instance; suppliers in debt have no origin."""
    p = _table(spark, sf_dir, "lineitem")
    rows = p.select(
        F.col("l_suppkey").alias("waypoint_id"), F.col("l_linenumber").cast("long").alias("instance_number"), (F.col("l_partkey") % 50).alias("vid"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_extendedprice") / 1000).alias("z"),
        (F.col("l_partkey") % 256).cast("int").alias("r"), (F.col("l_orderkey") % 256).cast("int").alias("g"), ((F.col("l_partkey") + F.col("l_orderkey")) % 256).cast("int").alias("b"),
    )
    origins = _table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("waypoint_id"), (F.col("s_acctbal") / 1000).alias("ox"), F.lit(0.0).alias("oy"), F.lit(1.0).alias("oz"))
    return rows, origins


def request_outcomes(spark, sf_dir):
    """Orders as a stream of requests: which are answered, with how many points, and why others are not."""
    run = _run(spark, "requests")
    rows, origins = _service_tables(spark, sf_dir)
    schema = _table(spark, sf_dir, "orders").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/orders*.parquet")
    instance = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 9)
    requests = source.select(F.col("o_orderkey").alias("request_id"), (F.col("o_custkey") % 130).alias("waypoint_id"), instance.alias("instance_number"))
    service.report_outcomes(requests, rows, origins, f"{run}/outcomes", f"{run}/checkpoint", min_points=5).awaitTermination()
    return spark.read.parquet(f"{run}/outcomes")


_WIDTH, _HEIGHT = 40, 30


def id_image_round_trip(spark, sf_dir):
    """Supervoxel-id images of eight scenes, written as PNG files from tasks and read back."""
    path = f"{_run(spark, 'images')}/voxel"
    p = _table(spark, sf_dir, "lineitem")
    members = p.groupBy((F.col("l_suppkey") % 8).cast("string").alias("scene_id"), ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % (_WIDTH * _HEIGHT)).alias("idx")).agg(F.max("l_partkey").cast("int").alias("vid"))
    grid = members.select("scene_id").distinct().select("scene_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_WIDTH * _HEIGHT - 1).cast("long"))).alias("idx"), F.lit(_WIDTH).alias("width"), F.lit(_HEIGHT).alias("height"))
    files.write_images(files.id_images(grid, members), path)
    r, g_, b = (F.get("values", F.lit(i)) for i in range(3))
    found = files.read_images(spark, path).select("scene_id", "idx", codec.rgb_to_segment_id(r, g_, b).alias("vid"))
    return found.where("vid > 0")


def scan_report(spark, sf_dir):
    """Which scenes can be scanned: customers as the list, orders, events and labels as files of three kinds."""
    t = lambda name, c, kind: _table(spark, sf_dir, name).select(F.col(c).alias("scene_id"), F.lit(kind).alias("kind"))
    found = t("orders", "o_custkey", "depth").union(t("events", "user_id", "color")).union(t("labels", "doc_id", "label"))
    return scan.report(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scene_id")), found, ["depth", "color", "label"])


def config_overlay(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,long>").alias("m"))
    both = overlaid(F.col("m"), {"mode": F.lit(1).cast("long"), "k": F.when(F.col("event_id") % 2 == 0, F.col("event_id"))})
    return e.select("event_id", both["k"].alias("k"), both["mode"].alias("mode"))


def service_response_pack(spark, sf_dir):
    p = _slices(spark, sf_dir).select(F.col("scene").cast("string").alias("waypoint_id"), "pidx", *[F.get("f3", F.lit(i)).alias(c) for i, c in enumerate("xyz")], decode.argmax(F.col("p")).alias("label"), F.col("p").alias("prob"))
    packed = decode.response(p, decode.label_frequencies(p, ["waypoint_id"]))
    return packed.select("waypoint_id", F.size("label").alias("n_points"), F.size("label_probabilities").alias("n_values"), F.size("label_frequencies").alias("n_classes"), F.size("points").alias("n_xyz"))


def service_response_points(spark, sf_dir):
    """The response's arrays, taken apart again: place, label and probabilities of each point, and its waypoint's share of its label."""
    p = _slices(spark, sf_dir).select(F.col("scene").cast("string").alias("waypoint_id"), "pidx", *[F.get("f3", F.lit(i)).alias(c) for i, c in enumerate("xyz")], decode.argmax(F.col("p")).alias("label"), F.col("p").alias("prob"))
    packed = decode.response(p, decode.label_frequencies(p, ["waypoint_id"]))
    return decode.unpacked_response(packed, 3).select("waypoint_id", "no", "label", *_rounded("x", "p0", "p1", "p2", "share", digits=5))


def label_counts(spark, sf_dir):
    """Names and labels of the taxonomy, and how many of its labels the events hold."""
    entries = taxonomy(spark, ENTRIES)
    met = _events(spark, sf_dir).select("label").distinct().join(F.broadcast(entries.select("label").distinct()), "label")  # a list of labels
    return taxonomy_counts(entries).crossJoin(met.where("label >= 0").agg(F.count("*").alias("n_met")))  # one row each


def label_report(spark, sf_dir):
    f = decode.label_frequencies(_slices(spark, sf_dir), ["scene"], "p")
    found = frequency_report(f.withColumn("freq", F.round("freq", 6)), taxonomy(spark, ENTRIES))
    return found.select("scene", "name", "freq")


def _labelled(spark, sf_dir) -> DataFrame:
    """Points of two scenes with labels, a seventh of them without depth."""
    rows = _table(spark, sf_dir, "lineitem")
    no_depth = F.col("l_partkey") % 7 == 0
    at = lambda c: F.when(~no_depth, c)
    return rows.select(
        (F.col("l_linenumber") % 2).alias("scene_id"), F.col("l_suppkey").alias("vid"), at(F.col("l_quantity")).alias("x"), at(F.col("l_discount") * 100).alias("y"), at(F.col("l_extendedprice") / 1000).alias("z"),
        (F.col("l_partkey") % 256).cast("int").alias("r"), (F.col("l_orderkey") % 256).cast("int").alias("g"), ((F.col("l_partkey") + F.col("l_orderkey")) % 256).cast("int").alias("b"), (F.col("l_orderkey") % 4 - 1).cast("int").alias("label"),
    )


def training_scan(spark, sf_dir):
    """Rows to train on, of all scenes: size, label and two of the features."""
    found = scene.training_rows(_labelled(spark, sf_dir), ["scene_id", "vid"], min_points=200)
    return found.select("scene_id", "vid", "n", "label", F.round(F.get("features", F.lit(0)), 6).alias("mean_z"), F.round(F.get("features", F.lit(1)), 6).alias("h0"))


def valid_point_totals(spark, sf_dir):
    return scene.valid_points(_labelled(spark, sf_dir).where("x is not null"), ["scene_id", "vid"], ["scene_id"], 250)


def posterior_to_points(spark, sf_dir):
    posterior = _slices(spark, sf_dir).select(F.col("pidx").alias("vid"), F.col("p").alias("prob"))
    found = scene.posterior_of_points(_points(spark, sf_dir), posterior, ["vid"])
    return found.groupBy("vid").agg(F.count("*").alias("n"), F.round(F.sum(F.get("p", F.lit(0))), 4).alias("p0"))


def published_cloud(spark, sf_dir):
    e = _events(spark, sf_dir)
    seen = e.select(F.col("vid").alias("waypoint_id"), "ts", "event_id", F.col("event_type").alias("frame_id"), F.col("value").alias("x"), (F.col("value") * 2).alias("y"), F.lit(1.0).alias("z"), *[F.lit(i).alias(c) for i, c in enumerate("rgb")])
    return scene.published(seen, ["ts", "event_id"])


def published_cloud_size(spark, sf_dir):
    return scene.published_size(published_cloud(spark, sf_dir))


# SQL ----------------------------------------------------------------------------------------

_STATS = "count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, " + ", ".join(f"covar_pop({a}, {b}) * count(*) AS {a}{b}" for a, b in _S)
_EIGEN = """e1 AS (SELECT *, (xx + yy + zz) / 3 AS q FROM stats),
e2 AS (SELECT *, sqrt(((xx-q)*(xx-q) + (yy-q)*(yy-q) + (zz-q)*(zz-q) + 2*(xy*xy + xz*xz + yz*yz)) / 6) AS p,
  (xx-q)*((yy-q)*(zz-q) - yz*yz) - xy*(xy*(zz-q) - yz*xz) + xz*(xy*yz - (yy-q)*xz) AS det FROM e1),
e3 AS (SELECT *, CASE WHEN p > 0 THEN acos(greatest(-1.0, least(1.0, det / (2*p*p*p)))) / 3 ELSE acos(0.0) / 3 END AS ang FROM e2),
e4 AS (SELECT *, q + 2*p*cos(ang) AS l2, q + 2*p*cos(ang + 2*pi()/3) AS l0 FROM e3),
eig AS (SELECT *, 3*q - l2 - l0 AS l1 FROM e4)"""


def _vector(name: str, value: str) -> str:
    """CTEs that add the unit eigenvector name_x, name_y, name_z of eigenvalue ``value`` to eig."""
    rows = (f"(xx-{value})", "xy", "xz"), ("xy", f"(yy-{value})", "yz"), ("xz", "yz", f"(zz-{value})")
    out, sizes = [], []
    for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        a, b = rows[i], rows[j]
        c = [f"{a[1]}*{b[2]} - {a[2]}*{b[1]}", f"{a[2]}*{b[0]} - {a[0]}*{b[2]}", f"{a[0]}*{b[1]} - {a[1]}*{b[0]}"]
        out += [f"{e} AS c{k}{x}" for e, x in zip(c, "xyz", strict=True)]
        sizes.append(f"c{k}x*c{k}x + c{k}y*c{k}y + c{k}z*c{k}z")
    pick = ", ".join(f"(CASE WHEN s0 >= s1 AND s0 >= s2 THEN c0{x} WHEN s1 >= s2 THEN c1{x} ELSE c2{x} END) / sqrt(greatest(s0, s1, s2)) AS {x}" for x in "xyz")
    return f"{name}_c AS (SELECT vid, {', '.join(out)} FROM eig), {name}_s AS (SELECT *, {sizes[0]} AS s0, {sizes[1]} AS s1, {sizes[2]} AS s2 FROM {name}_c), {name} AS (SELECT vid, {pick} FROM {name}_s)"


def _hist_sql(compat: bool) -> str:
    offs = (("r", 0), ("g", 17), ("b", 34))
    bins = [f"least({c} // 17 + {o}, 17)" if compat else f"least({c} // 17, 16) + {o}" for c, o in offs]
    cols = ", ".join(f"round(CAST(sum(" + " + ".join(f"CASE WHEN {b} = {i} THEN 1 ELSE 0 END" for b in bins) + f") AS DOUBLE) / count(*), 8) AS h{i}" for i in range(51))
    return f"WITH pc AS ({_PC}) SELECT vid, {cols} FROM pc GROUP BY vid"


def _neighbor_sql(compat: bool) -> str:
    dst = "e.src" if compat else "e.dst"
    h1 = "least(r // 17, 17)" if compat else "least(r // 17, 16)"
    h40 = "CASE WHEN least(b // 17 + 34, 17) = 39 THEN 1.0 ELSE 0.0 END" if compat else "CASE WHEN least(b // 17, 16) + 34 = 39 THEN 1.0 ELSE 0.0 END"
    extra = f", avg(CASE WHEN {h1} = 0 THEN 1.0 ELSE 0.0 END) AS h0, avg({h40}) AS h39"
    def part(name: str, source: str) -> str:
        return f"SELECT vid, {_STATS}{extra} FROM {source} GROUP BY vid"
    eig = lambda stats, k: _EIGEN.replace("stats", stats).replace("e1", f"e1{k}").replace("e2", f"e2{k}").replace("e3", f"e3{k}").replace("e4", f"e4{k}").replace("eig", f"eig{k}")
    sl = "a.l2 - a.l1" if compat else "(b.l2 - b.l1) - (a.l2 - a.l1)"
    return f"""WITH pc AS ({_PC}), s AS (SELECT s_suppkey AS k FROM supplier),
edges AS (SELECT a.k AS src, b.k AS dst FROM s a JOIN s b ON b.k = a.k - 1 OR b.k = a.k + 1),
allp AS (SELECT * FROM pc UNION ALL SELECT e.src AS vid, p.x, p.y, p.z, p.r, p.g, p.b FROM edges e JOIN pc p ON p.vid = {dst}),
sa AS ({part('a', 'pc')}), sb AS ({part('b', 'allp')}), {eig('sa', 'a')}, {eig('sb', 'b')}
SELECT a.vid, a.n, h.src IS NOT NULL AS has_neighbors, round(a.mz, 3) AS f0, round(a.l2 - a.l1, 3) AS f54,
 CASE WHEN h.src IS NULL THEN 0.0 ELSE round(b.mz, 3) END AS f65, round(a.h0, 5) AS f1, round(a.h39, 5) AS f40,
 CASE WHEN h.src IS NULL THEN 0.0 ELSE round(b.h0 - a.h0, 5) END AS f66, CASE WHEN h.src IS NULL THEN 0.0 ELSE round(b.h39 - a.h39, 5) END AS f105,
 CASE WHEN h.src IS NULL THEN 0.0 ELSE round(b.l0 - a.l0, 1) END AS f117, CASE WHEN h.src IS NULL THEN 0.0 ELSE round((b.l1 - b.l0) - (a.l1 - a.l0), 1) END AS f118,
 CASE WHEN h.src IS NULL AND NOT {str(compat).upper()} THEN 0.0 ELSE round({sl}, 1) END AS f119,
 CASE WHEN h.src IS NULL THEN 0.0 ELSE round(b.l0 / (b.l0 + b.l1 + b.l2) - a.l0 / (a.l0 + a.l1 + a.l2), 6) END AS f120
FROM eiga a JOIN eigb b ON a.vid = b.vid LEFT JOIN (SELECT DISTINCT src FROM edges) h ON h.src = a.vid"""


def _all_features_sql() -> str:
    bins = [(c, o) for c, o in (("r", 0), ("g", 17), ("b", 34))]
    hist = ", ".join("sum(" + " + ".join(f"CASE WHEN least({c} // 17, 16) + {o} = {i} THEN 1 ELSE 0 END" for c, o in bins) + f") AS h{i}" for i in range(51))

    def shaped(k: str, source: str, axes: bool) -> str:
        eig = _EIGEN.replace("FROM stats", f"FROM st{k}").replace("e1", f"e1{k}").replace("e2", f"e2{k}").replace("e3", f"e3{k}").replace("e4", f"e4{k}").replace("eig AS", f"eig{k} AS")
        vectors = ", ".join(_vector(f"v{n}{k}", value).replace("FROM eig)", f"FROM eig{k})") for n, value in (("0", "l0"), ("2", "l2")))
        values = "CASE WHEN e.mx*v0.x + e.my*v0.y + e.mz*v0.z < 0 THEN -1.0 ELSE 1.0 END AS s0, CASE WHEN v2.z < 0 THEN -1.0 ELSE 1.0 END AS s2"
        return f"""st{k} AS (SELECT vid, {_STATS}, {hist} FROM {source} GROUP BY vid), {eig}, {vectors},
sh{k} AS MATERIALIZED (SELECT e.*, l0 AS sp, l1-l0 AS ss, l2-l1 AS sl, greatest(l2-l1, l0, l1-l0) AS most, v0.x AS ax, v0.y AS ay, v0.z AS az, v2.x AS cx, v2.y AS cy, v2.z AS cz, {values} FROM eig{k} e JOIN v0{k} v0 USING (vid) JOIN v2{k} v2 USING (vid))"""

    axes = ("p.x*ax + p.y*ay + p.z*az", "p.x*(cy*az - cz*ay) + p.y*(cz*ax - cx*az) + p.z*(cx*ay - cy*ax)", "p.x*cx + p.y*cy + p.z*cz")
    box = lambda k, source: f"bx{k} AS (SELECT p.vid, {', '.join(f'max({a}) - min({a}) AS bb{i + 1}' for i, a in enumerate(axes))} FROM {source} p JOIN sha ON sha.vid = p.vid GROUP BY p.vid)"
    own = lambda t, b: [f"{t}.mz", *[f"{t}.h{i} / {t}.n" for i in range(51)], f"{t}.sp", f"{t}.ss", f"{t}.sl", f"{t}.l0 / ({t}.l0 + {t}.l1 + {t}.l2)", *[f"{t}.s0 * {t}.a{c}" for c in "xyz"], f"acos(greatest(-1.0, least(1.0, {t}.s0 * {t}.az)))", f"{t}.s0 * {t}.az * {t}.sl / {t}.most", f"{t}.s2 * {t}.cz * {t}.ss / {t}.most", *[f"{b}.bb{i}" for i in (1, 2, 3)]]
    a, b = own("a", "p"), own("b", "q")
    turn = "acos(greatest(-1.0, least(1.0, a.s0*b.s0*(a.ax*b.ax + a.ay*b.ay + a.az*b.az))))"
    differ = lambda i: f"({b[i]}) - ({a[i]})"
    every = [*a, b[0], *[differ(i) for i in range(1, 56)], turn, *[differ(i) for i in range(59, 65)]]
    digits = [*_DIGITS, _DIGITS[0], *_DIGITS[1:56], 4, *_DIGITS[59:65]]
    return f"""WITH pc AS ({_PC}), s AS (SELECT s_suppkey AS k FROM supplier), edges AS (SELECT a.k AS src, b.k AS dst FROM s a JOIN s b ON b.k = a.k - 1 OR b.k = a.k + 1),
allp AS (SELECT * FROM pc UNION ALL SELECT e.src AS vid, p.x, p.y, p.z, p.r, p.g, p.b FROM edges e JOIN pc p ON p.vid = e.dst),
{shaped('a', 'pc', True)}, {shaped('b', 'allp', False)}, {box('a', 'pc')}, {box('b', 'allp')},
f AS (SELECT a.vid, [{', '.join(f'round({v}, {d})' for v, d in zip(every, digits, strict=True))}] AS v FROM sha a JOIN shb b USING (vid) JOIN bxa p USING (vid) JOIN bxb q USING (vid))
SELECT vid, CAST(unnest(range(128)) AS INT) AS i, unnest(v) AS v FROM f"""


def _slices_sql() -> str:
    raw = ", ".join(f"exp(CAST(embedding[{11 + i}] AS DOUBLE) * 4) AS r{i}" for i in range(3))
    f6 = ", ".join(f"CAST(embedding[{1 + i}] AS DOUBLE) * 4 AS a{i}" for i in range(6))
    f3 = ", ".join(f"CAST(embedding[{1 + i}] AS DOUBLE) * 8 AS d{i}" for i in range(3))
    return f"raw AS (SELECT label AS scene, vec_id AS pidx, {raw}, {f6}, {f3} FROM embeddings), sl AS (SELECT *, r0/(r0+r1+r2) AS p0, r1/(r0+r1+r2) AS p1, r2/(r0+r1+r2) AS p2 FROM raw)"


def _mean_field_sql(final: str) -> str:
    k1 = "exp(-0.5 * (" + " + ".join(f"(a.a{i}-b.a{i})*(a.a{i}-b.a{i})" for i in range(6)) + "))"
    k2 = "exp(-0.5 * (" + " + ".join(f"(a.d{i}-b.d{i})*(a.d{i}-b.d{i})" for i in range(3)) + "))"
    steps, last = [f"w AS (SELECT a.scene, a.pidx, b.pidx AS o, {k1} AS k1, {k2} AS k2 FROM sl a JOIN sl b ON a.scene = b.scene AND a.pidx <> b.pidx)"], "q0"
    steps.append("q0 AS (SELECT scene, pidx, p0, p1, p2, p0 AS q0, p1 AS q1, p2 AS q2 FROM sl)")
    for k in (1, 2):
        m = ", ".join(f"2.0 * sum(k1 * q.q{c}) / sum(k1) + 1.0 * sum(k2 * q.q{c}) / sum(k2) AS m{c}" for c in range(3))
        steps.append(f"m{k} AS (SELECT w.scene, w.pidx, {m} FROM w JOIN {last} q ON q.scene = w.scene AND q.pidx = w.o GROUP BY w.scene, w.pidx)")
        e = ", ".join(f"ln(greatest(q.p{c}, 1e-6)) + coalesce(m.m{c}, 0) AS e{c}" for c in range(3))
        steps.append(f"en{k} AS (SELECT q.scene, q.pidx, q.p0, q.p1, q.p2, {e} FROM {last} q LEFT JOIN m{k} m ON m.scene = q.scene AND m.pidx = q.pidx)")
        top = "greatest(e0, e1, e2)"
        total = f"(exp(e0-{top}) + exp(e1-{top}) + exp(e2-{top}))"
        steps.append(f"q{k} AS (SELECT scene, pidx, p0, p1, p2, " + ", ".join(f"exp(e{c}-{top}) / {total} AS q{c}" for c in range(3)) + f" FROM en{k})")
        last = f"q{k}"
    return f"WITH {_slices_sql()}, {', '.join(steps)} {final.format(last)}"


def _lattice_sql(name: str, source: str, features: list[str]) -> list[str]:
    """CTEs: {name}_splat has the vertices' sums, {name} the messages of the marginals q0, q1, q2 of ``source``."""
    d = len(features)
    n = d + 1
    each = lambda f: ", ".join(f(i) for i in range(n))
    keep = "scene, pidx, q0, q1, q2"
    keys = [f"c{i}" for i in range(d)]
    scaled = ", ".join(f"{f} * {n * (2 / 3) ** 0.5 / ((i + 1) * (i + 2)) ** 0.5!r} AS s{i}" for i, f in enumerate(features))
    lifted = each(lambda i: " + ".join(["0.0", *[f"s{k}" for k in range(i, d)]]) + (f" - {i} * s{i - 1}" if i else "") + f" AS e{i}")
    rank = each(lambda i: " + ".join(["t", *[f"CAST(d{j} {'>=' if j < i else '>'} d{i} AS INT)" for j in range(n) if j != i]]) + f" AS k{i}")
    turn = each(lambda i: f"CASE WHEN k{i} < 0 THEN 1 WHEN k{i} > {d} THEN -1 ELSE 0 END AS m{i}")
    way = lambda m: 1 + 2 * 0.5**n if m == 0 else 0.5**m + 0.5 ** (n - m)
    alone = " + ".join(f"b{k} * b{m} * {way(abs(k - m))!r}" for k in range(n) for m in range(n))
    corner = " UNION ALL ".join(f"SELECT {keep}, alone, b{k} AS w, " + ", ".join(f"CAST(r{i} + CASE WHEN k{i} <= {d - k} THEN {k} ELSE {k - n} END AS BIGINT) AS c{i}" for i in range(d)) + f" FROM {name}_b" for k in range(n))
    out = [
        f"{name}_s AS (SELECT {keep}, {scaled} FROM {source})",
        f"{name}_e AS (SELECT {keep}, {lifted} FROM {name}_s)",
        f"{name}_r AS (SELECT *, {each(lambda i: f'floor(e{i} / {n} + 0.5) AS r{i}')} FROM {name}_e)",
        f"{name}_d AS (SELECT *, {each(lambda i: f'e{i} - r{i} * {n} AS d{i}')}, CAST({' + '.join(f'r{i}' for i in range(n))} AS INT) AS t FROM {name}_r)",
        f"{name}_k AS (SELECT {keep}, {each(lambda i: f'e{i}, r{i}')}, {rank} FROM {name}_d)",
        f"{name}_m AS (SELECT *, {turn} FROM {name}_k)",
        f"{name}_n AS (SELECT {keep}, {each(lambda i: f'e{i}')}, {each(lambda i: f'k{i} + m{i} * {n} AS k{i}')}, {each(lambda i: f'(r{i} + m{i}) * {n} AS r{i}')} FROM {name}_m)",
        f"{name}_v AS (SELECT *, list_reverse_sort([{each(lambda i: f'(e{i} - r{i}) / {n}')}]) AS v FROM {name}_n)",
        f"{name}_w AS (SELECT *, 1 + v[{n}] - v[1] AS b0, {', '.join(f'v[{n - k}] - v[{n + 1 - k}] AS b{k}' for k in range(1, n))} FROM {name}_v)",
        f"{name}_b AS MATERIALIZED (SELECT *, {alone} AS alone FROM {name}_w)",
        f"{name}_c AS MATERIALIZED ({corner})",
        f"{name}_splat AS MATERIALIZED (SELECT scene, {', '.join(keys)}, sum(w) AS n, sum(w * q0) AS v0, sum(w * q1) AS v1, sum(w * q2) AS v2 FROM {name}_c GROUP BY scene, {', '.join(keys)})",
    ]
    last, every = f"{name}_splat", [*keys, f"(-({' + '.join(keys)}))"]
    for j in range(n):
        lead = 1 if j == 0 else 0
        window = f"(PARTITION BY scene, {', '.join(f'{every[i]} - {every[lead]}' for i in range(n) if i not in (j, lead))} ORDER BY {every[lead]})"
        blurred = ", ".join(f"{c} + 0.5 * (CASE WHEN lag({every[lead]}) OVER w = {every[lead]} - 1 THEN lag({c}) OVER w ELSE 0.0 END + CASE WHEN lead({every[lead]}) OVER w = {every[lead]} + 1 THEN lead({c}) OVER w ELSE 0.0 END) AS {c}" for c in ("n", "v0", "v1", "v2"))
        out.append(f"{name}_x{j} AS MATERIALIZED (SELECT scene, {', '.join(keys)}, {blurred} FROM {last} WINDOW w AS {window})")
        last = f"{name}_x{j}"
    out.append(f"{name}_y AS (SELECT scene, pidx, any_value(q0) AS q0, any_value(q1) AS q1, any_value(q2) AS q2, any_value(alone) AS alone, sum(w * n) - any_value(alone) AS rest, sum(w * v0) AS v0, sum(w * v1) AS v1, sum(w * v2) AS v2 FROM {name}_c JOIN {last} USING (scene, {', '.join(keys)}) GROUP BY scene, pidx)")
    mean = ", ".join(f"CASE WHEN rest > 1e-6 THEN greatest(0.0, least(1.0, (v{c} - alone * q{c}) / rest)) ELSE 0.0 END AS m{c}" for c in range(3))
    return [*out, f"{name} AS MATERIALIZED (SELECT scene, pidx, {mean} FROM {name}_y)"]


_A6, _D3 = [f"a{i}" for i in range(6)], [f"d{i}" for i in range(3)]
_Q0 = "q0 AS (SELECT *, p0 AS q0, p1 AS q1, p2 AS q2 FROM sl)"


def _lattice_field_sql() -> str:
    steps, last = [_Q0], "q0"
    for k in (1, 2):
        steps += [*_lattice_sql(f"a{k}", last, _A6), *_lattice_sql(f"s{k}", last, _D3)]
        energy = ", ".join(f"ln(greatest(q.p{c}, 1e-6)) + 2.0 * coalesce(a.m{c}, 0) + 1.0 * coalesce(s.m{c}, 0) AS x{c}" for c in range(3))
        steps.append(f"en{k} AS (SELECT q.*, {energy} FROM {last} q LEFT JOIN a{k} a USING (scene, pidx) LEFT JOIN s{k} s USING (scene, pidx))")
        top = "greatest(x0, x1, x2)"
        total = f"(exp(x0-{top}) + exp(x1-{top}) + exp(x2-{top}))"
        steps.append(f"q{k} AS (SELECT scene, pidx, p0, p1, p2, {', '.join(_A6 + _D3)}, " + ", ".join(f"exp(x{c}-{top}) / {total} AS q{c}" for c in range(3)) + f" FROM en{k})")
        last = f"q{k}"
    return f"WITH {_slices_sql()}, {', '.join(steps)} SELECT scene, pidx, round(q0, 4) AS q0, round(q1, 4) AS q1, round(q2, 4) AS q2 FROM {last}"


def _normals_sql() -> str:
    near = "abs(a.i-b.i) <= 1 AND abs(a.j-b.j) <= 1 AND abs(a.k-b.k) <= 1"
    first = ", ".join(f"sum(b.n * (b.m{c} - a.m{c})) AS s{c}" for c in "xyz")
    second = ", ".join(f"sum(b.{p} + b.n * (b.m{p[0]} - a.m{p[0]}) * (b.m{p[1]} - a.m{p[1]})) AS {p}" for p in _S)
    return f"""WITH pc AS ({_PC}), cell AS (SELECT CAST(floor(x/5.0) AS BIGINT) AS i, CAST(floor(y/5.0) AS BIGINT) AS j, CAST(floor(z/5.0) AS BIGINT) AS k, x, y, z FROM pc),
v AS (SELECT row_number() OVER () AS vid, i, j, k, {_STATS} FROM cell GROUP BY i, j, k),
touch AS (SELECT a.vid AS s, b.vid AS d FROM v a JOIN v b ON {near}),
two AS (SELECT DISTINCT a.s, b.d FROM touch a JOIN touch b ON a.d = b.s),
sums AS (SELECT two.s AS vid, sum(b.n) AS n, {first}, {second}, any_value(a.mx) AS mx, any_value(a.my) AS my, any_value(a.mz) AS mz FROM two JOIN v a ON a.vid = two.s JOIN v b ON b.vid = two.d GROUP BY two.s),
stats AS (SELECT vid, n, mx, my, mz, sx, sy, sz, {', '.join(f'{p} - s{p[0]} * s{p[1]} / n AS {p}' for p in _S)} FROM sums), {_EIGEN}, {_vector('va', 'l0')},
o AS (SELECT eig.*, va.x AS vx, va.y AS vy, va.z AS vz, va.x*(mx+sx/n) + va.y*(my+sy/n) + va.z*(mz+sz/n) > 0 AS away, n >= 3 AND l1 - l0 > 1e-6 * (l0+l1+l2) AS surface FROM eig JOIN va USING (vid))
SELECT 0 AS scene, i, j, k, {', '.join(f'CASE WHEN surface THEN round(CASE WHEN away THEN -v{c} ELSE v{c} END, 3) END AS n{c}' for c in 'xyz')} FROM o JOIN v USING (vid)"""


def _consensus_sql(final: str) -> str:
    import math

    steps = f"""pc AS (SELECT l_suppkey % 10 AS vid, l_orderkey * 10 + l_linenumber AS idx, l_quantity AS x, l_discount AS y, l_extendedprice / 1000 AS z FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY md5('0:' || CAST(idx AS VARCHAR)), idx, x, y, z) - 1 AS k FROM pc QUALIFY k < {3 * _PLANES}),
t AS (SELECT vid, CAST(k // 3 AS INT) AS h, {', '.join(f'max(CASE WHEN k % 3 = {i} THEN {c} END) AS {p}_{c}' for i, p in enumerate('abc') for c in 'xyz')} FROM k GROUP BY vid, k // 3 HAVING count(*) = 3),
n AS (SELECT *, (b_y-a_y)*(c_z-a_z) - (b_z-a_z)*(c_y-a_y) AS u, (b_z-a_z)*(c_x-a_x) - (b_x-a_x)*(c_z-a_z) AS v, (b_x-a_x)*(c_y-a_y) - (b_y-a_y)*(c_x-a_x) AS w FROM t),
m AS (SELECT *, sqrt(u*u + v*v + w*w) AS size, CASE WHEN v > 0 THEN -1.0 ELSE 1.0 END / sqrt(u*u + v*v + w*w) AS up FROM n WHERE sqrt(u*u + v*v + w*w) > 1e-12),
planes AS MATERIALIZED (SELECT vid, h, u*up AS nx, v*up AS ny, w*up AS nz, -(u*up*a_x + v*up*a_y + w*up*a_z) AS d FROM m WHERE abs(v*up) >= {math.cos(0.5)!r}),
hits AS (SELECT vid, h, count(*) AS score FROM pc JOIN planes USING (vid) WHERE abs(nx*x + ny*y + nz*z + d) <= {_NEAR} GROUP BY vid, h),
scored AS MATERIALIZED (SELECT planes.*, coalesce(score, 0) AS score FROM planes LEFT JOIN hits USING (vid, h)),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY vid ORDER BY score DESC, h) = 1),
near AS (SELECT pc.* FROM pc JOIN best USING (vid) WHERE abs(nx*x + ny*y + nz*z + d) <= {_NEAR}),
stats AS (SELECT vid, {_STATS} FROM near GROUP BY vid HAVING count(*) >= 3), {_EIGEN}, {_vector('va', 'l0')},
fit AS (SELECT vid, va.x * s AS nx, va.y * s AS ny, va.z * s AS nz, -s * (va.x*mx + va.y*my + va.z*mz) AS d FROM (SELECT *, CASE WHEN y > 0 THEN -1.0 ELSE 1.0 END AS s FROM va) va JOIN eig USING (vid))"""
    return f"WITH {steps} {final}"


def _outcomes_sql() -> str:
    return """WITH q AS (SELECT o_orderkey AS request_id, o_custkey % 130 AS waypoint_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 9 END AS instance_number FROM orders),
p AS (SELECT l_suppkey AS w, CAST(l_linenumber AS BIGINT) AS i, l_partkey % 50 AS vid FROM lineitem),
v AS (SELECT w, NULL AS i, vid, count(*) AS n FROM p GROUP BY w, vid UNION ALL SELECT w, i, vid, count(*) AS n FROM p GROUP BY w, i, vid),
s AS (SELECT w, i, CAST(sum(CASE WHEN n >= 5 THEN n ELSE 0 END) AS BIGINT) AS n_points FROM v GROUP BY w, i),
o AS (SELECT s_suppkey AS w FROM supplier WHERE s_acctbal >= 0),
a AS (SELECT q.*, CASE WHEN s.w IS NULL THEN 'no cloud' WHEN o.w IS NULL THEN 'no origin' WHEN n_points = 0 THEN 'no supervoxel' ELSE 'ok' END AS status, n_points
  FROM q LEFT JOIN s ON s.w = q.waypoint_id AND s.i IS NOT DISTINCT FROM q.instance_number LEFT JOIN o ON o.w = q.waypoint_id)
SELECT request_id, waypoint_id, instance_number, status, CASE WHEN status = 'ok' THEN n_points ELSE 0 END AS n_points FROM a"""


def _gradient_sql() -> str:
    energy = ", ".join(f"ln(greatest(q.p{c}, 1e-6)) + 2.0 * coalesce(a.m{c}, 0) + 1.0 * coalesce(s.m{c}, 0) AS x{c}" for c in range(3))
    messages = ", ".join(f"coalesce({t}.m{c}, 0) AS {t}{c}" for t in "as" for c in range(3))
    top = "greatest(x0, x1, x2)"
    off = ", ".join(f"CAST(y = {c} AS INT) - exp(x{c} - {top}) / (exp(x0 - {top}) + exp(x1 - {top}) + exp(x2 - {top})) AS o{c}" for c in range(3))
    weight = ", ".join(f"round(avg({' + '.join(f'o{c} * {t}{c}' for c in range(3))}), 5) AS w{k}" for k, t in enumerate("as"))
    pair = ", ".join(f"round(avg(o{i} * (2.0 * a{j} + 1.0 * s{j})), 5) AS c{i}{j}" for i in range(3) for j in range(3))
    return f"""WITH {_slices_sql()}, {_Q0}, {', '.join([*_lattice_sql('a', 'q0', _A6), *_lattice_sql('s', 'q0', _D3)])},
e AS (SELECT q.pidx % 4 - 1 AS y, {messages}, {energy} FROM q0 q LEFT JOIN a USING (scene, pidx) LEFT JOIN s USING (scene, pidx)),
o AS (SELECT *, {off}, CASE y WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END - {top} - ln(exp(x0 - {top}) + exp(x1 - {top}) + exp(x2 - {top})) AS l FROM e WHERE y >= 0)
SELECT count(*) AS n, round(avg(l), 5) AS l, {weight}, {pair} FROM o"""


def _plane_sql() -> str:
    steps, near = [f"pc AS (SELECT vid, x, y / 100 AS y, z FROM ({_PC}))"], "pc"
    for k in range(3):
        eig = _EIGEN.replace("FROM stats", f"FROM st{k}").replace("e1", f"e1_{k}").replace("e2", f"e2_{k}").replace("e3", f"e3_{k}").replace("e4", f"e4_{k}").replace("eig AS", f"eig{k} AS")
        steps += [f"st{k} AS (SELECT vid, {_STATS} FROM {near} GROUP BY vid HAVING count(*) >= 3)", eig, _vector(f"v{k}", "l0").replace("FROM eig)", f"FROM eig{k})")]
        steps.append(f"p{k} AS MATERIALIZED (SELECT vid, n, v.x * s AS nx, v.y * s AS ny, v.z * s AS nz, -s * (v.x*mx + v.y*my + v.z*mz) AS d FROM (SELECT *, CASE WHEN y > 0 THEN -1.0 ELSE 1.0 END AS s FROM v{k}) v JOIN eig{k} USING (vid))")
        if k < 2:
            steps.append(f"n{k} AS MATERIALIZED (SELECT pc.* FROM pc JOIN p{k} USING (vid) WHERE abs(nx*x + ny*y + nz*z + d) <= {0.05 * 4.0 ** (1 - k)!r})")
            near = f"n{k}"
    return f"WITH {', '.join(steps)} SELECT vid, n AS inliers, round(nx, 4) AS nx, round(ny, 4) AS ny, round(nz, 4) AS nz, round(d, 4) AS d FROM p2"


def _grid_sql() -> str:
    """Two mean-field steps of the smoothness kernel by way of cells, as ``crf.grid_messages``."""
    steps, last = [_Q0, "sp AS (SELECT a.i, b.i AS j, c.i AS k, exp(-0.5 * (a.i*a.i + b.i*b.i + c.i*c.i)) AS w FROM range(-2, 3) a(i), range(-2, 3) b(i), range(-2, 3) c(i))"], "q0"
    cell = "CAST(floor(d0) AS BIGINT) AS c0, CAST(floor(d1) AS BIGINT) AS c1, CAST(floor(d2) AS BIGINT) AS c2"
    for k in (1, 2):
        steps.append(f"s{k} AS (SELECT scene, {cell}, count(*) AS n, sum(q0) AS s0, sum(q1) AS s1, sum(q2) AS s2 FROM {last} GROUP BY ALL)")
        steps.append(f"g{k} AS MATERIALIZED (SELECT scene, c0 + i AS c0, c1 + j AS c1, c2 + k AS c2, sum(w * n) AS n, sum(w * s0) AS s0, sum(w * s1) AS s1, sum(w * s2) AS s2 FROM s{k}, sp GROUP BY 1, 2, 3, 4)")
        energy = ", ".join(f"ln(greatest(p{c}, 1e-6)) + CASE WHEN n - 1 > 1e-9 THEN (s{c} - q{c}) / (n - 1) ELSE 0.0 END AS x{c}" for c in range(3))
        steps.append(f"en{k} AS (SELECT q.scene, pidx, p0, p1, p2, d0, d1, d2, {energy} FROM (SELECT *, {cell} FROM {last}) q JOIN g{k} USING (scene, c0, c1, c2))")
        top = "greatest(x0, x1, x2)"
        total = f"(exp(x0-{top}) + exp(x1-{top}) + exp(x2-{top}))"
        steps.append(f"q{k} AS (SELECT scene, pidx, p0, p1, p2, d0, d1, d2, " + ", ".join(f"exp(x{c}-{top}) / {total} AS q{c}" for c in range(3)) + f" FROM en{k})")
        last = f"q{k}"
    return f"WITH {_slices_sql()}, {', '.join(steps)} SELECT scene, pidx, round(q0, 4) AS q0, round(q1, 4) AS q1, round(q2, 4) AS q2 FROM {last}"


_DIVERGENCE = f"""WITH {_slices_sql()}, p AS (SELECT scene < 5 AS one, pidx, d0 AS x, d1 AS y, d2 AS z FROM sl),
c AS (SELECT one, count(*) AS n, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM p GROUP BY one, floor(x / 0.25), floor(y / 0.25), floor(z / 0.25)),
t AS (SELECT one, sum(n) AS total FROM c GROUP BY one),
s AS (SELECT p.pidx, c.one, sum(CASE WHEN o <= 16 THEN n * exp(-o / 2) ELSE 0 END) AS s FROM (SELECT * FROM p WHERE one) p CROSS JOIN c CROSS JOIN LATERAL (SELECT (p.x-c.x)*(p.x-c.x) + (p.y-c.y)*(p.y-c.y) + (p.z-c.z)*(p.z-c.z) AS o) GROUP BY p.pidx, c.one),
d AS (SELECT pidx, one, greatest(s / (total * pow(2 * pi(), 1.5)), 1e-9) AS d FROM s JOIN t USING (one))
SELECT count(*) AS n, round(avg(ln(a.d / b.d)), 6) AS kl FROM d a JOIN d b ON a.pidx = b.pidx AND a.one AND NOT b.one"""


_BIT = lambda c: " + ".join(f"((((p_partkey >> {i}) & 1)) << {7 - i // 3})" for i in range(c, 24, 3))
_LIN = lambda c: f"(CASE WHEN {c}/255.0 <= 0.04045 THEN {c}/255.0/12.92 ELSE pow(({c}/255.0 + 0.055)/1.055, 2.4) END)"
_ROOT = lambda c: f"(CASE WHEN {c} > 0.008856 THEN pow({c}, 1.0/3) ELSE 7.787*{c} + 16.0/116 END)"

_LABELLED = "SELECT CAST(l_linenumber % 2 AS INT) AS scene_id, l_suppkey AS vid, l_extendedprice / 1000 AS z, l_partkey, CAST(l_orderkey % 4 - 1 AS INT) AS label FROM lineitem WHERE l_partkey % 7 <> 0"

SQL = {
    "label_counts": f"WITH t(ord, name, label, r, g, b) AS (VALUES {_ENTRIES}) SELECT count(DISTINCT name) AS n_names, count(DISTINCT label) FILTER (label >= 0) AS n_labels, (SELECT count(DISTINCT {_LABEL}) FROM events WHERE {_LABEL} >= 0) AS n_met FROM t",
    "label_report": f"WITH t(ord, name, label, r, g, b) AS (VALUES {_ENTRIES}), u AS (SELECT label, arg_max(name, ord) AS name FROM t GROUP BY label), {_slices_sql()}, f AS (SELECT scene, unnest([0, 1, 2]) AS label, unnest([avg(p0), avg(p1), avg(p2)]) AS freq FROM sl GROUP BY scene) SELECT scene, name, round(freq, 6) AS freq FROM f LEFT JOIN u USING (label)",
    "training_scan": f"WITH pc AS ({_LABELLED}), big AS (SELECT scene_id, vid, count(*) AS n, round(avg(z), 6) AS mean_z, round(avg(CASE WHEN l_partkey % 256 < 17 THEN 1.0 ELSE 0.0 END), 6) AS h0 FROM pc GROUP BY 1, 2 HAVING count(*) >= 200), c AS (SELECT scene_id, vid, label, count(*) AS k FROM pc WHERE label >= 0 GROUP BY 1, 2, 3), m AS (SELECT *, row_number() OVER (PARTITION BY scene_id, vid ORDER BY k DESC, label) AS o FROM c) SELECT scene_id, vid, n, label, mean_z, h0 FROM big JOIN m USING (scene_id, vid) WHERE o = 1",
    "valid_point_totals": f"WITH pc AS ({_LABELLED}), big AS (SELECT scene_id, vid, count(*) AS n FROM pc GROUP BY 1, 2 HAVING count(*) >= 250) SELECT scene_id, CAST(sum(n) AS BIGINT) AS n_points, count(*) AS n_voxels FROM big GROUP BY 1",
    "posterior_to_points": f"WITH {_slices_sql()} SELECT l_suppkey AS vid, count(*) AS n, round(sum(p0), 4) AS p0 FROM lineitem JOIN sl ON sl.pidx = l_suppkey GROUP BY 1",
    "published_cloud": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, first_value(event_type) OVER (ORDER BY ts DESC, event_id DESC) AS f FROM events) SELECT user_id AS waypoint_id, f AS fused_frame, value AS x, value * 2 AS y, CAST(1.0 AS DOUBLE) AS z, 0 AS r, 1 AS g, 2 AS b FROM r WHERE k = 1",
    "published_cloud_size": "SELECT count(DISTINCT user_id) AS n_points FROM events",
    "majority_class_distribution": f"WITH e AS (SELECT user_id AS vid, {_LABEL} AS label FROM events), big AS (SELECT vid FROM e GROUP BY vid HAVING count(*) >= 10), c AS (SELECT vid, label, count(*) AS n FROM e WHERE vid IN (SELECT vid FROM big) GROUP BY vid, label), m AS (SELECT vid, label, row_number() OVER (PARTITION BY vid ORDER BY n DESC, label) AS k FROM c WHERE label >= 0), t(ord, name, label, r, g, b) AS (VALUES {_ENTRIES}) SELECT m.label AS label, arg_max(t.name, t.ord) AS name, any_value(m.n) AS n FROM (SELECT label, count(*) AS n FROM m WHERE k = 1 GROUP BY label) m JOIN t ON t.label = m.label GROUP BY m.label",
    "taxonomy_last_wins": f"WITH t(ord, name, label, r, g, b) AS (VALUES {_ENTRIES}), u AS (SELECT label, arg_max(name, ord) AS name, arg_max(r, ord) AS r, arg_max(g, ord) AS g, arg_max(b, ord) AS b FROM t GROUP BY label), e AS (SELECT {_LABEL} AS label, count(*) AS n FROM events GROUP BY 1) SELECT e.label, u.name, u.r, u.g, u.b, e.n FROM e JOIN u ON u.label = e.label",
    "strict_label_lookup": f"WITH t(ord, name, label, r, g, b) AS (VALUES {_ENTRIES}) SELECT 1000000*t.r + 1000*t.g + t.b AS key, t.label, count(*) AS n FROM events e JOIN t ON t.name = e.event_type GROUP BY 1, 2",
    "depth_validity_filter": "WITH d AS (SELECT l_suppkey, CAST(trunc(l_extendedprice - 2000) AS INT) AS d FROM lineitem), m AS (SELECT l_suppkey, CASE WHEN d > 0 AND d <= 10000 THEN d / 1000.0 END AS m FROM d) SELECT l_suppkey, count(*) AS n, count(m) AS valid, round(sum(m), 3) AS metres FROM m GROUP BY l_suppkey",
    "backproject_rigid": "WITH d AS (SELECT l_suppkey, l_partkey AS idx, CAST(trunc(l_extendedprice / 100) AS INT) AS d FROM lineitem), z AS (SELECT l_suppkey, idx, CASE WHEN d > 0 AND d <= 10000 THEN d / 1000.0 END AS z FROM d), u AS (SELECT l_suppkey, 0.5*((idx % 64)*z) - 0.5*z AS ux, 0.25*((idx // 64)*z) - 0.25*z AS uy, z AS uz FROM z) SELECT l_suppkey, round(avg(ux), 7) AS ux, round(avg(uy), 7) AS uy, round(avg(uz), 7) AS uz, round(avg(-uy), 7) AS px, round(avg(ux), 7) AS py, round(avg(uz + 1.5), 7) AS pz FROM u GROUP BY l_suppkey",
    "center_uncenter": f"WITH pc AS ({_PC}), o AS (SELECT s_suppkey AS vid, s_acctbal/1000 AS ox, CAST(s_nationkey AS DOUBLE) AS oy, 1.0 AS oz FROM supplier) SELECT vid, round(avg(x-ox), 7) AS mean_cx, round(avg(y-oy), 7) AS mean_cy, round(avg(z-oz), 7) AS mean_cz, round(avg(x), 7) AS mean_x, round(avg(y), 7) AS mean_y, round(avg(z), 7) AS mean_z FROM pc JOIN o USING (vid) GROUP BY vid",
    "rgb_to_lab": f"WITH pc AS ({_PC}), l AS (SELECT vid, {_LIN('r')} AS lr, {_LIN('g')} AS lg, {_LIN('b')} AS lb FROM pc), t AS (SELECT vid, (0.412453*lr + 0.357580*lg + 0.180423*lb)/0.950456 AS x, 0.212671*lr + 0.715160*lg + 0.072169*lb AS y, (0.019334*lr + 0.119193*lg + 0.950227*lb)/1.088754 AS z FROM l) SELECT vid, round(avg(round((CASE WHEN y > 0.008856 THEN 116*pow(y, 1.0/3) - 16 ELSE 903.3*y END)*2.55)), 1) AS light, round(avg(round(500*({_ROOT('x')} - {_ROOT('y')}) + 128)), 1) AS a_star, round(avg(round(200*({_ROOT('y')} - {_ROOT('z')}) + 128)), 1) AS b_star FROM t GROUP BY vid",
    "segment_id_codec": f"SELECT p_partkey, CAST({_BIT(0)} AS INT) AS r, CAST({_BIT(1)} AS INT) AS g, CAST({_BIT(2)} AS INT) AS b, CAST(p_partkey AS INT) AS back FROM part",
    "voxel_group_size_having": "SELECT l_suppkey AS vid, count(*) AS n FROM lineitem WHERE l_suppkey > 0 GROUP BY l_suppkey HAVING count(*) >= 590",
    "voxel_centroid": f"WITH pc AS ({_PC}) SELECT vid, round(avg(x), 7) AS mx, round(avg(y), 7) AS my, round(avg(z), 7) AS mz FROM pc GROUP BY vid",
    "voxel_color_histogram_intended": _hist_sql(False),
    "voxel_color_histogram_compat": _hist_sql(True),
    "voxel_scatter_matrix": f"WITH pc AS ({_PC}), m AS (SELECT vid, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM pc GROUP BY vid) SELECT vid, count(*) AS n, " + ", ".join(f"round(sum(({a}-m{a})*({b}-m{b})) / count(*), 6) AS {a}{b}" for a, b in _S) + " FROM pc JOIN m USING (vid) GROUP BY vid",
    "voxel_eigen_shape": f"WITH pc AS ({_PC}), stats AS (SELECT vid, {_STATS} FROM pc GROUP BY vid), {_EIGEN} SELECT vid, round(l0, 2) AS sigma_p, round(l1-l0, 2) AS sigma_s, round(l2-l1, 2) AS sigma_l, round(l0/(l0+l1+l2), 6) AS curvature FROM eig",
    "voxel_normal_bbox": f"WITH pc AS ({_PC}), stats AS (SELECT vid, {_STATS} FROM pc GROUP BY vid), {_EIGEN}, {_vector('va', 'l0')}, {_vector('vc', 'l2')}, ax AS (SELECT e.vid, mx, my, mz, va.x AS ax, va.y AS ay, va.z AS az, vc.x AS cx, vc.y AS cy, vc.z AS cz FROM eig e JOIN va ON va.vid = e.vid JOIN vc ON vc.vid = e.vid), b3 AS (SELECT *, cy*az - cz*ay AS bx, cz*ax - cx*az AS by_, cx*ay - cy*ax AS bz FROM ax), box AS (SELECT p.vid, max(p.x*ax + p.y*ay + p.z*az) - min(p.x*ax + p.y*ay + p.z*az) AS bb1, max(p.x*bx + p.y*by_ + p.z*bz) - min(p.x*bx + p.y*by_ + p.z*bz) AS bb2, max(p.x*cx + p.y*cy + p.z*cz) - min(p.x*cx + p.y*cy + p.z*cz) AS bb3 FROM pc p JOIN b3 ON b3.vid = p.vid GROUP BY p.vid), sg AS (SELECT *, CASE WHEN mx*ax + my*ay + mz*az < 0 THEN -1 ELSE 1 END AS s FROM ax) SELECT sg.vid, round(s*ax, 4) AS nx, round(s*ay, 4) AS ny, round(s*az, 4) AS nz, round(bb1, 3) AS bb1, round(bb2, 3) AS bb2, round(bb3, 3) AS bb3 FROM sg JOIN box ON box.vid = sg.vid",
    "neighbor_features_intended": _neighbor_sql(False),
    "neighbor_features_compat": _neighbor_sql(True),
    "neighbor_features_all": _all_features_sql(),
    "image_semi_join": "SELECT l_suppkey AS vid, count(*) AS n FROM lineitem WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal > 0) GROUP BY l_suppkey",
    "pixel_zip_join": "SELECT e.label AS d, l.quality, count(*) AS n, CAST(sum(e.vec_id) AS BIGINT) AS sum_idx FROM embeddings e JOIN labels l ON l.doc_id = e.vec_id GROUP BY 1, 2",
    "scatter_default": "SELECT p.p_partkey AS idx, coalesce(v.n, -1) AS label FROM part p LEFT JOIN (SELECT user_id * 7 AS idx, count(*) AS n FROM events GROUP BY 1) v ON v.idx = p.p_partkey",
    "jitter_expand": f"SELECT j.k AS jitter_no, round(0.2 + j.v, 3) AS seed_resolution, {_LABEL} AS label, count(*) AS n FROM events CROSS JOIN (VALUES (0, -0.05), (1, -0.025), (2, 0.0), (3, 0.025), (4, 0.05)) j(k, v) GROUP BY 1, 2, 3",
    "jitter_accumulate_compat": "SELECT CAST(j.k AS INT) AS jitter_no, user_id AS vid, count(*) AS n FROM events JOIN range(5) j(k) ON event_id % 5 <= j.k GROUP BY 1, 2",
    "point_index": f"SELECT label, event_id, row_number() OVER (PARTITION BY label ORDER BY user_id, event_id) - 1 AS pidx FROM (SELECT *, {_LABEL} AS label FROM events)",
    "argmax_decode": f"WITH {_slices_sql()} SELECT pidx, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS label FROM sl",
    "label_frequencies": f"WITH {_slices_sql()} SELECT scene, 0 AS label, round(avg(p0), 6) AS freq FROM sl GROUP BY scene UNION ALL SELECT scene, 1, round(avg(p1), 6) FROM sl GROUP BY scene UNION ALL SELECT scene, 2, round(avg(p2), 6) FROM sl GROUP BY scene",
    "unary_energy": f"WITH {_slices_sql()} SELECT pidx, round(-ln(p0), 5) AS u0, round(-ln(p1), 5) AS u1, round(-ln(p2), 5) AS u2 FROM sl",
    "crf_gaussian_messages": f"WITH {_slices_sql()}, w AS (SELECT a.scene, a.pidx, b.p0, b.p1, b.p2, exp(-0.5*((a.d0-b.d0)*(a.d0-b.d0) + (a.d1-b.d1)*(a.d1-b.d1) + (a.d2-b.d2)*(a.d2-b.d2))) AS k FROM sl a JOIN sl b ON a.scene = b.scene AND a.pidx <> b.pidx) SELECT scene, pidx, round(sum(k*p0)/sum(k), 5) AS m0, round(sum(k*p1)/sum(k), 5) AS m1, round(sum(k*p2)/sum(k), 5) AS m2 FROM w GROUP BY scene, pidx",
    "crf_mean_field_2iter": _mean_field_sql("SELECT scene, pidx, round(q0, 4) AS q0, round(q1, 4) AS q1, round(q2, 4) AS q2 FROM {}"),
    "crf_map": _mean_field_sql("SELECT scene, pidx, CASE WHEN q0 >= q1 AND q0 >= q2 THEN 0 WHEN q1 >= q2 THEN 1 ELSE 2 END AS label FROM {}"),
    "crf_lattice_splat": f"WITH {_slices_sql()}, {_Q0}, {', '.join(_lattice_sql('l', 'q0', _D3))} SELECT scene, c0, c1, c2, round(n, 5) AS n, round(v0, 5) AS v0, round(v1, 5) AS v1, round(v2, 5) AS v2 FROM l_splat",
    "crf_lattice_messages": f"WITH {_slices_sql()}, {_Q0}, {', '.join(_lattice_sql('l', 'q0', _A6))} SELECT scene, pidx, round(m0, 4) AS m0, round(m1, 4) AS m1, round(m2, 4) AS m2 FROM l",
    "crf_lattice": _lattice_field_sql(),
    "service_response_points": f"WITH {_slices_sql()}, a AS (SELECT CAST(scene AS VARCHAR) AS waypoint_id, pidx, d0, p0, p1, p2, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS label FROM sl) SELECT waypoint_id, CAST(row_number() OVER (PARTITION BY waypoint_id ORDER BY pidx) - 1 AS INT) AS no, label, round(d0, 5) AS x, round(p0, 5) AS p0, round(p1, 5) AS p1, round(p2, 5) AS p2, round(CASE label WHEN 0 THEN avg(p0) OVER w WHEN 1 THEN avg(p1) OVER w ELSE avg(p2) OVER w END, 5) AS share FROM a WINDOW w AS (PARTITION BY waypoint_id)",
    "plane_fit": _plane_sql(),
    "crf_grid": _grid_sql(),
    "service_response_pack": "SELECT CAST(label AS VARCHAR) AS waypoint_id, CAST(count(*) AS INT) AS n_points, CAST(3 * count(*) AS INT) AS n_values, 3 AS n_classes, CAST(count(*) AS INT) AS n_xyz FROM embeddings GROUP BY label",
    "crf_gradient": _gradient_sql(),
    "importance_swaps": "WITH h AS (SELECT vec_id AS id, embedding, row_number() OVER (ORDER BY substr(md5('oob:' || vec_id), 1, 2), md5('oob:' || vec_id), vec_id) AS place, count(*) OVER () AS n FROM embeddings WHERE CAST('0x' || substr(md5('oob:' || vec_id), 1, 8) AS BIGINT) % 3 = 0), e AS (SELECT a.id, k.c, a.embedding[k.c + 1] AS own, b.id AS donor, b.embedding[k.c + 1] AS value FROM h a CROSS JOIN range(5) k(c) JOIN h b ON b.place = (a.place - 1 + 7919 * (k.c + 1)) % a.n + 1) SELECT CAST(c AS INT) AS c, count(*) AS n, CAST(sum(CAST(value <> own AS INT)) AS BIGINT) AS changed, count(DISTINCT donor) AS donors, CAST(sum(donor * (id % 7)) AS BIGINT) AS mark FROM e GROUP BY c",
    "cloud_divergence": _DIVERGENCE,
    "supervoxel_grid": f"WITH pc AS ({_PC}) SELECT 0 AS scene, CAST(floor(x/5.0) AS BIGINT) AS i, CAST(floor(y/5.0) AS BIGINT) AS j, CAST(floor(z/5.0) AS BIGINT) AS k, count(*) AS n, round(avg(x), 7) AS x, round(avg(y), 7) AS y, round(avg(z), 7) AS z, round(avg(r), 7) AS r FROM pc GROUP BY 2, 3, 4",
    "supervoxel_adjacency": f"WITH pc AS ({_PC}), v AS (SELECT DISTINCT CAST(floor(x/5.0) AS BIGINT) AS i, CAST(floor(y/5.0) AS BIGINT) AS j, CAST(floor(z/5.0) AS BIGINT) AS k FROM pc) SELECT 0 AS scene, a.i, a.j, a.k, count(*) AS neighbours FROM v a JOIN v b ON abs(a.i-b.i) <= 1 AND abs(a.j-b.j) <= 1 AND abs(a.k-b.k) <= 1 AND NOT (a.i = b.i AND a.j = b.j AND a.k = b.k) GROUP BY 2, 3, 4",
    "plane_hypotheses": _consensus_sql("SELECT vid, h, round(nx, 6) AS nx, round(ny, 6) AS ny, round(nz, 6) AS nz, round(d, 6) AS d, score FROM scored"),
    "plane_consensus": _consensus_sql("SELECT vid, round(nx, 5) AS nx, round(ny, 5) AS ny, round(nz, 5) AS nz, round(d, 5) AS d, count(*) AS inliers FROM fit JOIN pc USING (vid) WHERE abs(nx*x + ny*y + nz*z + d) <= " + str(_NEAR) + " GROUP BY vid, nx, ny, nz, d"),
    "voxel_normals": _normals_sql(),
    "supervoxel_camera_grid": f"WITH pc AS ({_PC}), c AS (SELECT CAST(floor(x / z / 0.25) AS BIGINT) AS i, CAST(floor(y / z / 0.25) AS BIGINT) AS j, CAST(floor(ln(z) / 0.25) AS BIGINT) AS k, x, y, z, avg(z) OVER (PARTITION BY floor(x / z / 0.25), floor(y / z / 0.25), floor(ln(z) / 0.25)) AS mz FROM pc) SELECT 0 AS scene, i, j, k, count(*) AS n, round(avg(x) * count(*), 5) AS x, round(avg(y) * count(*), 5) AS y, round(avg(z) * count(*), 5) AS z, round(max(abs(z - mz)) * count(*), 5) AS depth FROM c GROUP BY 2, 3, 4",
    "minmax_rescale": "SELECT p_partkey, round((p_retailprice - lo)/(hi - lo)*255.0, 4) AS scaled FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)",
    "fused_latest_by_waypoint": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, first_value(event_type) OVER (ORDER BY ts DESC, event_id DESC) AS f FROM events) SELECT user_id AS vid, event_id, value, f AS fused_frame FROM r WHERE k = 1",
    "stream_cache_replay": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id AS vid, event_id, value FROM r WHERE k = 1",
    "stream_cache_snapshots": "WITH r AS (SELECT b.k AS version, e.*, row_number() OVER (PARTITION BY b.k, user_id ORDER BY ts DESC, event_id DESC) AS o, first_value(event_type) OVER (PARTITION BY b.k ORDER BY ts DESC, event_id DESC) AS f FROM events e JOIN range(5) b(k) ON event_id % 5 <= b.k) SELECT CAST(version AS INT) AS version, user_id AS vid, event_id, value, f AS fused_frame FROM r WHERE o = 1",
    "request_outcomes": _outcomes_sql(),
    "id_image_round_trip": f"SELECT CAST(l_suppkey % 8 AS VARCHAR) AS scene_id, (l_orderkey * 7 + l_linenumber) % {_WIDTH * _HEIGHT} AS idx, CAST(max(l_partkey) AS INT) AS vid FROM lineitem GROUP BY 1, 2",
    "scan_report": "WITH f AS (SELECT o_custkey AS scene_id, 'depth' AS kind FROM orders UNION SELECT user_id, 'color' FROM events UNION SELECT doc_id, 'label' FROM labels), h AS (SELECT scene_id, bool_or(kind = 'depth') AS d, bool_or(kind = 'color') AS c, bool_or(kind = 'label') AS l FROM f GROUP BY scene_id), j AS (SELECT coalesce(c_custkey, scene_id) AS scene_id, c_custkey IS NOT NULL AS listed, coalesce(d, false) AS d, coalesce(c, false) AS c, coalesce(l, false) AS l FROM customer FULL JOIN h ON scene_id = c_custkey) SELECT scene_id, CASE WHEN NOT listed THEN 'unlisted' WHEN d AND c AND l THEN 'complete' ELSE 'incomplete' END AS status, concat_ws(',', CASE WHEN NOT d THEN 'depth' END, CASE WHEN NOT c THEN 'color' END, CASE WHEN NOT l THEN 'label' END) AS missing FROM j",
    "config_overlay": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, CAST(1 AS BIGINT) AS mode FROM events",
}
QUERIES = {
    f.__name__: f
    for f in (
        majority_class_distribution, taxonomy_last_wins, strict_label_lookup, depth_validity_filter, backproject_rigid, center_uncenter, rgb_to_lab, segment_id_codec, voxel_group_size_having,
        voxel_centroid, voxel_color_histogram_intended, voxel_color_histogram_compat, voxel_scatter_matrix, voxel_eigen_shape, voxel_normal_bbox, neighbor_features_intended, neighbor_features_compat, neighbor_features_all,
        image_semi_join, pixel_zip_join, scatter_default, jitter_expand, jitter_accumulate_compat, point_index, argmax_decode, label_frequencies, unary_energy, crf_gaussian_messages,
        crf_mean_field_2iter, crf_map, crf_grid, crf_lattice_splat, crf_lattice_messages, crf_lattice, crf_gradient, importance_swaps, cloud_divergence, rf_train_predict, supervoxel_grid, supervoxel_adjacency, supervoxel_full, voxel_normals, supervoxel_camera_grid, supervoxel_camera, plane_fit, plane_hypotheses, plane_consensus, minmax_rescale, fused_latest_by_waypoint, stream_cache_replay, stream_cache_snapshots, request_outcomes, id_image_round_trip, scan_report,
        config_overlay, service_response_pack, service_response_points, label_counts, label_report, training_scan, valid_point_totals, posterior_to_points, published_cloud, published_cloud_size,
    )
}

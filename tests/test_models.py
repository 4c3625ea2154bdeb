"""Learning a CRF, importance of a forest's columns, densities and divergence of clouds."""

import math

import numpy as np
import pytest

from voxelflow.operators import crf, crf_learning, density, forest, growing, importance

POINT = "scene long, pidx long, label int, p array<double>, f6 array<double>, f3 array<double>"


def labelled(spark, n=300, seed=1):
    """Two classes in blobs, with uncertain probabilities; a third of the points has no label."""
    rng = np.random.default_rng(seed)
    xyz = rng.uniform(0, 4, (n, 3))
    y = (xyz[:, 0] > 2).astype(int)
    p = np.clip(0.5 + (y - 0.5) * 0.3 + rng.normal(0, 0.2, n), 0.05, 0.95)
    return spark.createDataFrame([(k % 2, k, -1 if k % 3 == 0 else int(y[k]), [float(1 - p[k]), float(p[k])], [*xyz[k].tolist(), 0.0, 0.0, 0.0], (xyz[k] * 2).tolist()) for k in range(n)], POINT), y


def test_gradient_is_that_of_finite_differences(spark):
    rows = crf_learning.with_messages(labelled(spark)[0], 2).cache()
    w, c = np.array([0.7, 0.4]), np.array([[1.0, -0.2], [0.1, 0.8]])
    _, by_weight, by_pair, n = crf_learning.likelihood(rows, w, c)
    assert n == 200
    at = lambda w, c: crf_learning.likelihood(rows, w, c)[0]
    e = 1e-5
    for k in range(2):
        d = np.eye(2)[k] * e
        assert by_weight[k] == pytest.approx((at(w + d, c) - at(w - d, c)) / (2 * e), abs=1e-6)
    for i in range(2):
        for j in range(2):
            d = np.zeros((2, 2))
            d[i, j] = e
            assert by_pair[i, j] == pytest.approx((at(w, c + d) - at(w, c - d)) / (2 * e), abs=1e-6)
    # the likelihood is that of one mean-field step
    points, _ = labelled(spark)
    q = {r["pidx"]: r["q"] for r in crf.mean_field(points, 2, *w.tolist(), iterations=1, compatibility=c.tolist()).collect()}
    want = np.mean([math.log(q[r["pidx"]][r["label"]]) for r in points.where("label >= 0").collect()])
    assert at(w, c) == pytest.approx(want, abs=1e-9)


def test_likelihood_rises(spark):
    points, y = labelled(spark)
    rows = crf_learning.with_messages(points, 2).cache()
    found = crf_learning.learn(rows, 2, (0.1, 0.1), steps=6)
    assert len(found.history) > 2 and all(b > a for a, b in zip(found.history, found.history[1:], strict=False))
    assert found.history[-1] > found.history[0] + 0.05

    def right(weights, compatibility):
        q = crf.mean_field(points, 2, *weights, iterations=1, compatibility=compatibility).collect()
        return np.mean([(r["q"][1] > 0.5) == y[r["pidx"]] for r in q])

    assert right(found.weights.tolist(), found.compatibility.tolist()) > right([0.0, 0.0], np.eye(2).tolist())
    none = crf_learning.learn(rows.where("label < 0"), 2, (0.3, 0.2), steps=2)
    assert none.weights.tolist() == [0.3, 0.2]


def test_planted_column_ranks_first(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (600, 6))
    rows = [(k, int(x[k, 3] > 0), x[k].tolist()) for k in range(600)] + [(1000, -1, [0.0] * 6), (None, 1, [0.0] * 6)]
    frame = spark.createDataFrame(rows, "id long, label int, features array<double>")
    model, found = importance.fit_and_rank(frame, "id", 6, trees=15, depth=5, min_split=4)
    got = {r["c"]: r for r in found.collect()}
    assert set(got) == set(range(6)) and max(got, key=lambda c: got[c]["importance"]) == 3
    assert got[3]["importance"] > 0.3 and all(abs(got[c]["importance"]) < 0.1 for c in got if c != 3)
    each = importance.swapped(frame.where("id < 10"), "id", 6).collect()
    for c in range(6):  # a permutation of the column
        of = [r for r in each if r["c"] == c]
        assert sorted(r["donor"] for r in of) == sorted(r["id"] for r in of) == list(range(10))
        assert all(r["value"] == x[r["donor"], c] for r in of)


def test_forest_grows_by_groups(spark, tmp_path):
    """Every node of every tree holds just the rows that the tree draws and its splits send there; wide nodes are
    split before their rows meet, and groups are no larger than they may be."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (900, 9))
    x[:, 4] = np.where(np.arange(900) < 880, 0, np.where(np.arange(900) < 890, 1, 2))  # few values, two of them rare
    x[700:] = x[700]  # no split parts these
    y = np.where(x[:, 2] > 0.3, 2, (x[:, 5] > 0).astype(int))
    rows = spark.createDataFrame([(int(b), a.tolist()) for a, b in zip(x, y, strict=True)], "label int, features array<double>").coalesce(1)
    for group in (60, 1 << 15):
        model = forest.fit(rows, trees=5, depth=8, min_split=10, seed=7, group=group)
        forest.save(model, str(tmp_path / f"m{group}"))
        trees = {}
        for r in spark.read.parquet(str(tmp_path / f"m{group}" / "data")).collect():
            trees.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"]
        assert sorted(trees) == list(range(5))
        for t, nodes in trees.items():
            assert sorted(nodes) == list(range(len(nodes)))
            weight = growing.drawn(np.arange(900), t, 7)
            assert 800 < weight.sum() < 1000

            def held(at, here, level):
                n = nodes[at]  # noqa: B023
                want = np.bincount(y[here], weight[here], 3)  # noqa: B023
                assert n["impurityStats"] == want.tolist() and n["rawCount"] == want.sum() and n["prediction"] == want.argmax()
                if n["leftChild"] < 0:
                    return
                assert level < 8 and want.max() < want.sum()
                left = x[here, n["split"]["featureIndex"]] <= n["split"]["leftCategoriesOrThreshold"][0]
                assert min(weight[here[left]].sum(), weight[here[~left]].sum()) >= 5  # noqa: B023
                held(n["leftChild"], here[left], level + 1)
                held(n["rightChild"], here[~left], level + 1)

            held(0, np.arange(900), 0)
        found = forest.posterior(model, rows).collect()
        assert np.mean([np.argmax(r["prob"]) == r["label"] for r in found]) > 0.9
    ids, bins = np.arange(900), rng.integers(0, 32, (900, 9)).astype(np.uint8)
    blocks = spark.createDataFrame([(bytearray(ids[k::3].tobytes()), bytearray(y[k::3].astype(np.int32).tobytes()), bytearray(bins[k::3].tobytes())) for k in range(3)], growing.BLOCK)
    for top in growing.tops(blocks, 900, growing.Shape(3, 8, 5, 7, 9, 3, 60)):
        leaves = [k for k, link in enumerate(top.links) if link[0] < 0]
        assert len(leaves) > 14 and all(top.done[k] or top.stats[k].sum() <= 60 for k in leaves)


def test_forest_thresholds(spark):
    """Values that only a few rows have are parted too; rows of other lengths, nulls and no rows are refused."""
    value = [0.0] * 970 + [1.0] * 20 + [2.0] * 10
    rows = spark.createDataFrame([(0, [v, float(k)]) for k, v in enumerate(value)], "label int, features array<double>")
    few, many = forest._thresholds(rows, 1000)
    assert few.tolist() == [0.0, 1.0] and len(many) == 31 and np.abs(np.diff(many) - 1000 / 32).max() <= 2
    for odd in ([1.0], [None, 1.0], [float("nan"), 1.0], None):
        with pytest.raises(ValueError):
            forest.fit(rows.union(spark.createDataFrame([(0, odd)], rows.schema)), trees=2, depth=2)
    with pytest.raises(ValueError):
        forest.fit(rows.where("label > 0"), trees=2, depth=2)


CLOUD = "id long, x double, y double, z double"


def cloud(spark, p):
    return spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(p)], CLOUD)


def test_density_near_exact(spark):
    rng = np.random.default_rng(3)
    a, b, h = rng.normal(0, 1, (400, 3)), np.concatenate([rng.normal(0, 1, (3000, 3)), rng.normal(3, 0.2, (500, 3))]), 0.5
    points = cloud(spark, a).union(spark.createDataFrame([(9999, None, None, None), (9998, 1e6, 0.0, 0.0)], CLOUD))
    got = {r["id"]: r["density"] for r in density.density(points, cloud(spark, b), h, "id").collect()}
    k = np.exp(-((a[:, None] - b[None]) ** 2).sum(2) / (2 * h * h)).mean(1) / ((2 * math.pi) ** 1.5 * h**3)
    most = 1 / ((2 * math.pi) ** 1.5 * h**3)
    assert max(abs(got[i] - k[i]) for i in range(400)) < most * (3 / 128 + math.exp(-8))  # the stated bound
    assert np.mean([abs(got[i] - k[i]) / k[i] for i in range(400)]) < 0.02
    assert got[9999] == got[9998] == 0.0


def test_divergence(spark):
    rng = np.random.default_rng(4)
    a, far = rng.normal(0, 1, (1500, 3)), rng.normal(0, 1, (1500, 3)) + [1.5, 0, 0]
    same = rng.normal(0, 1, (1500, 3))
    at = lambda p, q: density.divergence(cloud(spark, p), cloud(spark, q), 0.5, "id").head()["kl"]
    assert at(a, a) == pytest.approx(0, abs=1e-12) and abs(at(a, same)) < 0.3 and 0.6 < at(a, far) < 1.8  # in theory 1.125 without smoothing
    assert density.divergence(cloud(spark, a).limit(0), cloud(spark, a), 0.5, "id").head()["n"] == 0

"""The lattice filter against the exact Gaussian sums."""

import numpy as np
import pytest

from voxelflow.operators import crf, lattice

POINT = "scene long, pidx long, p array<double>, f6 array<double>, f3 array<double>"


def room(n, seed=0):
    """Points on the walls of a room, with two kinds of colours, and uncertain labels: (p, f6, f3)."""
    rng = np.random.default_rng(seed)
    xyz = rng.uniform(0, 1, (n, 3)) * [3, 3, 2.5]
    xyz[np.arange(n), rng.integers(0, 3, n)] = 0
    label = (xyz @ [1, 1.3, 0.7] > 2.6).astype(int)
    rgb = np.where(label[:, None] == 1, [120, 80, 60], [60, 100, 150]) + rng.normal(0, 15, (n, 3))
    p = np.clip(0.2 + 0.6 * label + rng.normal(0, 0.15, n), 0.02, 0.98)
    return np.stack([p, 1 - p], 1), np.concatenate([xyz / 0.6, rgb / 30], 1), xyz / 0.15


def exact(f, q):
    k = np.exp(-0.5 * ((f[:, None] - f[None]) ** 2).sum(2))
    np.fill_diagonal(k, 0)
    return k @ q / k.sum(1, keepdims=True)


def rows(p, f6, f3, scene=0):
    return [(scene, k, *(x[k].tolist() for x in (p, f6, f3))) for k in range(len(p))]


@pytest.mark.parametrize(("feature", "dims", "mean", "late"), [("f3", 3, 0.01, 0.08), ("f6", 6, 0.01, 0.08)])
def test_messages_near_exact(spark, feature, dims, mean, late):
    p, f6, f3 = room(5000)
    got = lattice.lattice_messages(spark.createDataFrame(rows(p, f6, f3), POINT), feature, 2, dims, "p").collect()
    want = exact({"f3": f3, "f6": f6}[feature], p)
    error = np.abs(np.array([[r["m0"], r["m1"]] for r in got]) - want[[r["pidx"] for r in got]])
    assert len(got) == 5000 and error.mean() < mean and np.percentile(error, 99) < late


def test_mean_field_near_exact(spark):
    """Both kernels by default; the labels are those of the exact sums."""
    points = spark.createDataFrame(rows(*room(700)), POINT)
    near = {r["pidx"]: r["q"] for r in crf.mean_field(points, 2).collect()}
    want = {r["pidx"]: r["q"] for r in crf.mean_field(points, 2, method="exact").collect()}
    assert np.mean([abs(near[k][0] - want[k][0]) for k in want]) < 0.02
    assert np.mean([(near[k][0] > 0.5) == (want[k][0] > 0.5) for k in want]) > 0.99


@pytest.mark.parametrize("dims", [1, 2, 5])
def test_corners(dims):
    """Weights are barycentric: not negative, of sum 1, and the corners' weighted mean is the point."""
    f = np.concatenate([np.random.default_rng(dims).normal(0, 3, (500, dims)), np.zeros((1, dims)), np.round(np.random.default_rng(9).normal(0, 3, (50, dims)))])
    place, weight, alone = lattice.corners_of(f)
    assert weight.min() > -1e-9 and np.allclose(weight.sum(1), 1) and (alone > 0).all()
    full = np.concatenate([place, -place.sum(2, keepdims=True)], 2)
    assert all(len({x % (dims + 1) for x in c}) == 1 for c in full.reshape(-1, dims + 1).tolist())
    moved, _, _ = lattice.corners_of(f + 0.0)
    assert (moved == place).all()
    mean = (full * weight[:, :, None]).sum(1)  # on the plane: the differences of two points' means are those of their places
    again = (np.concatenate([lattice.corners_of(f[:1])[0], -lattice.corners_of(f[:1])[0].sum(2, keepdims=True)], 2) * lattice.corners_of(f[:1])[1][:, :, None]).sum(1)
    assert np.allclose(((mean - again) ** 2).sum(1), ((f - f[0]) ** 2).sum(1) * (dims + 1) ** 2 * 2 / 3)


def test_odd_points(spark):
    nan, inf = float("nan"), float("inf")
    p, f6, f3 = room(60)
    odd = [(0, 100, [0.5, 0.5], None, None), (0, 101, [0.5, 0.5], [nan] * 6, [nan] * 3), (0, 102, [0.5, 0.5], [inf] * 6, [0.0, None, 0.0]), (0, 103, [0.5, 0.5], [1.0], [1.0]), (1, 0, [0.9, 0.1], [0.0] * 6, [0.0] * 3)]
    twice = [(2, 0, [1.0, 0.0], [0.0] * 6, [0.0] * 3), (2, 1, [0.0, 1.0], [0.0] * 6, [0.0] * 3)]
    points = spark.createDataFrame(rows(p, f6, f3) + odd + twice, POINT)
    got = {(r["scene"], r["pidx"]): (r["m0"], r["m1"]) for r in lattice.lattice_messages(points, "f3", 2, 3, "p").collect()}
    assert set(got) == {(0, k) for k in range(60)} | {(1, 0), (2, 0), (2, 1)}
    assert got[1, 0] == (0.0, 0.0)  # no other point
    assert got[2, 0] == pytest.approx((0, 1), abs=1e-9) and got[2, 1] == pytest.approx((1, 0), abs=1e-9)
    assert crf.mean_field(points, 2).count() == 67
    assert lattice.lattice_messages(points.limit(0), "f3", 2, 3, "p").count() == 0


def test_rows_per_point(spark):
    """Splat and slice make d + 1 rows a point."""
    points = spark.createDataFrame(rows(*room(100)), POINT)
    corners = lattice.simplex(points, "f6", 6).collect()
    assert all(len(r["corner"]) == 7 for r in corners)
    total = lattice.splat(lattice.simplex(points, "f6", 6), [], 6).agg({"n": "sum"}).head()[0]
    assert total == pytest.approx(100)

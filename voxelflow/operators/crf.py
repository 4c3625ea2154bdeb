"""Dense CRF over points: two Gaussian kernels, Potts compatibility, mean field.

Points: scene, pidx, p (array of class probabilities), f6 and f3 (scaled features). A message is
the kernel-weighted mean of the other points' marginals, so agreeing neighbours lower the energy.
``lattice`` filters on the permutohedral lattice, in proportion to the points: on 5,000 points of a
room its messages are off by 0.01 at the mean and 0.08 in 99 of 100 cases at most (see the tests).
``exact`` weighs all pairs of a scene's points, block by block in tasks; ``grid``
sums marginals over cells one sigma wide and exchanges them between near cells."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelflow.operators.decode import argmax
from voxelflow.operators.lattice import lattice_messages
from voxelflow.operators.lineage import cut

#: Points of a block of the exact kernel, and of a side of the tiles that a task works on.
BLOCK, TILE = 4096, 256


def scaled_features(xyz: tuple, rgb: tuple, range_sigma: float = 0.6, color_sigma: float = 30.0, smooth_sigma: float = 0.15) -> tuple[Column, Column]:
    """f6 and f3."""
    return F.array(*[c / range_sigma for c in xyz], *[c / color_sigma for c in rgb]), F.array(*[c / smooth_sigma for c in xyz])


def _tile(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[a, b] kernel values, from the differences of each component."""
    d, step = np.zeros((len(a), len(b))), np.empty((len(a), len(b)))
    for x, y in zip(a.T, b.T, strict=True):
        np.subtract(x[:, None], y, out=step)
        step *= step
        d += step
    d *= -0.5
    return np.exp(d, out=d)


def _weighed(k: np.ndarray, q: np.ndarray, same: np.ndarray | None) -> np.ndarray:
    """Sums of q by the weights k, without the ``same`` points (weight 0)."""
    if np.isfinite(q).all():
        return k @ q
    each = [k * c for c in q.T]
    return np.stack([(e if same is None else np.where(same, 0.0, e)).sum(1) for e in each], 1)


def _block_sums(classes: int, rows: pa.Table) -> pa.Table:
    """Kernel sums of the points of two blocks over each other (side 0 and 1), or of one block over itself
    (side 2). A point without features gives and gets nothing, a marginal that is not given counts in w only."""
    side, valid = rows["side"].to_numpy(), np.asarray(rows["f"].is_valid())
    point = np.unique(rows["pidx"].to_numpy(), return_inverse=True)[1]
    q, given = (rows[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(side), classes) for c in ("q", "given"))
    q = np.concatenate([q, np.ones((len(side), 1))], 1)
    f = rows["f"].combine_chunks().flatten().to_numpy()
    f = f.reshape(valid.sum(), -1) if valid.any() else np.empty((0, 0))
    at = np.cumsum(valid) - 1
    own = bool((side == 2).any())
    known = given & valid[:, None]
    if own:
        others = len(side) - np.bincount(point)[point]
        seen = known.sum(0) - np.stack([np.bincount(point, c)[point] for c in known.T.astype(float)], 1)
    else:
        others = np.where(side == 0, (side == 1).sum(), (side == 0).sum())
        seen = np.where(side[:, None] == 0, known[side == 1].sum(0), known[side == 0].sum(0))
    total = np.zeros(q.shape)
    left, right = np.flatnonzero(valid & (side != 1)), np.flatnonzero(valid & (side != 0))
    for i in range(0, len(left), TILE):
        a = left[i : i + TILE]
        for j in range(0, len(right), TILE):
            b = right[j : j + TILE]
            k, same = _tile(f[at[a]], f[at[b]]), None
            if own:
                same = point[a][:, None] == point[b]
                k[same] = 0.0
            else:
                total[b] += _weighed(k.T, q[a], None)
            total[a] += _weighed(k, q[b], same)
    seen = np.where(valid[:, None], seen, 0).astype(np.int64)
    listed = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), classes).cast(pa.list_(pa.from_numpy_dtype(x.dtype)))
    columns = [rows["scene"], rows["pidx"], pa.array(others.astype(np.int64)), pa.array(total[:, -1]), listed(np.ascontiguousarray(total[:, :-1])), listed(seen)]
    return pa.table(columns, names=["scene", "pidx", "others", "w", "s", "seen"]).filter(pa.array(others > 0))


def kernel_messages(points: DataFrame, feature: str, classes: int, q: str = "q") -> DataFrame:
    """scene, pidx, m0..: exact messages of one kernel. A scene is cut into blocks of about BLOCK points by a
    hash of pidx; a group holds two blocks at most and gives back sums for each point, so no pair becomes a
    row. The work is that of all pairs of a scene. Rows of one pidx are one point; a null feature has no
    kernel; where all kernel values are too small for a double, the message is NaN, as 0 / 0 is."""
    get = [F.get(q, F.lit(c)).cast("double") for c in range(classes)]
    f = F.when(~F.exists(feature, lambda x: x.isNull()), F.col(feature).cast("array<double>"))
    rows = points.where("scene is not null and pidx is not null")
    blocks = rows.groupBy("scene").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = rows.select("scene", "pidx", f.alias("f"), F.array(*[F.coalesce(c, F.lit(0.0)) for c in get]).alias("q"), F.array(*[c.isNotNull() for c in get]).alias("given"))
    placed = placed.join(blocks, "scene").withColumn("block", F.pmod(F.xxhash64("pidx"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    dealt = placed.select("scene", "pidx", "f", "q", "given", side.alias("side"), F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    kind = {x.name: x.dataType.simpleString() for x in placed.schema}
    schema = f"scene {kind['scene']}, pidx {kind['pidx']}, others long, w double, s array<double>, seen array<long>"
    sums = dealt.groupBy("scene", "first", "second").applyInArrow(lambda group: _block_sums(classes, group), schema)
    each = lambda name, c: F.sum(F.get(name, F.lit(c)))
    sums = sums.groupBy("scene", "pidx").agg(F.sum("w").alias("w"), *[each("s", c).alias(f"s{c}") for c in range(classes)], *[each("seen", c).alias(f"n{c}") for c in range(classes)])
    mean = lambda c: F.when(F.col("w") != 0, F.try_divide(f"s{c}", "w")).otherwise(F.lit(float("nan")))
    return sums.select("scene", "pidx", *[F.when(F.col(f"n{c}") > 0, mean(c)).alias(f"m{c}") for c in range(classes)])


def grid_messages(points: DataFrame, feature: str, classes: int, dims: int, radius: int = 2, q: str = "q") -> DataFrame:
    """scene, pidx, m0..: messages by way of cells; (2 radius + 1)^dims near cells get a cell's sums."""
    cell = [F.floor(F.get(feature, F.lit(i))).alias(f"c{i}") for i in range(dims)]
    placed = points.select("scene", "pidx", q, *cell)
    names = [f"c{i}" for i in range(dims)]
    sums = placed.groupBy("scene", *names).agg(F.count("*").alias("n"), *[F.sum(F.get(q, F.lit(c))).alias(f"s{c}") for c in range(classes)])
    steps = [(d, sum(x * x for x in d)) for d in itertools.product(range(-radius, radius + 1), repeat=dims)]
    spread = sums.withColumn("d", F.explode(F.array(*[F.struct(*[F.lit(x).alias(f"d{i}") for i, x in enumerate(d)], F.lit(s).alias("s")) for d, s in steps])))
    w = F.exp(-0.5 * F.col("d.s"))
    near = spread.select("scene", *[(F.col(f"c{i}") + F.col(f"d.d{i}")).alias(f"c{i}") for i in range(dims)], (w * F.col("n")).alias("n"), *[(w * F.col(f"s{c}")).alias(f"s{c}") for c in range(classes)])
    got = near.groupBy("scene", *names).agg(F.sum("n").alias("n"), *[F.sum(f"s{c}").alias(f"s{c}") for c in range(classes)])
    own = placed.join(got, ["scene", *names])
    rest = F.col("n") - 1  # without the point itself
    return own.select("scene", "pidx", *[F.when(rest > 1e-9, (F.col(f"s{c}") - F.get(q, F.lit(c))) / rest).otherwise(0.0).alias(f"m{c}") for c in range(classes)])


def messages(points: DataFrame, feature: str, classes: int, dims: int, method: str = "lattice", q: str = "q") -> DataFrame:
    """scene, pidx, m0..: the messages of one kernel by ``lattice``, ``exact`` or ``grid``."""
    if method == "exact":
        return kernel_messages(points, feature, classes, q)
    if method == "grid":
        return grid_messages(points, feature, classes, dims, 1 if dims > 3 else 2, q)
    if method == "lattice":
        return lattice_messages(points, feature, classes, dims, q)
    raise ValueError(f"unknown method {method}")


def _supported(c: int, classes: int, compatibility: list[list[float]] | None) -> Column:
    if compatibility is None:
        return F.col(f"m{c}")
    return sum((F.col(f"m{k}") * float(compatibility[c][k]) for k in range(classes)), F.lit(0.0))


def mean_field(points: DataFrame, classes: int, appearance: float = 10.0, smoothness: float = 5.0, iterations: int = 2, method: str = "lattice", dims: tuple[int, int] = (6, 3), compatibility: list[list[float]] | None = None) -> DataFrame:
    """scene, pidx, q: marginals after the iterations. ``compatibility`` [class of a point, class of its
    neighbours] weighs the messages; without it only equal classes support each other (Potts)."""
    now = points.withColumn("q", F.col("p"))
    for _ in range(iterations):
        kernels = [(f, w, d) for f, w, d in (("f6", appearance, dims[0]), ("f3", smoothness, dims[1])) if w]
        total, names = now.select("scene", "pidx", "p", "f6", "f3"), []
        for f, w, d in kernels:
            m = messages(now, f, classes, d, method).select("scene", "pidx", *[(_supported(c, classes, compatibility) * w).alias(f"{f}_{c}") for c in range(classes)])
            total = total.join(m, ["scene", "pidx"], "left")
            names.append(f)
        energy = [F.ln(F.greatest(F.get("p", F.lit(c)), F.lit(1e-6))) + sum((F.coalesce(F.col(f"{f}_{c}"), F.lit(0.0)) for f in names), F.lit(0.0)) for c in range(classes)]
        top = F.greatest(*energy)
        raw = [F.exp(e - top) for e in energy]
        norm = sum(raw[1:], raw[0])
        now = cut(total.select("scene", "pidx", "p", "f6", "f3", F.array(*[r / norm for r in raw]).alias("q")))
    return now.select("scene", "pidx", "q")


def map_labels(marginals: DataFrame) -> DataFrame:
    return marginals.select("scene", "pidx", argmax(F.col("q")).alias("label"))

"""Supervoxels as groups of points: size, majority label, colour histogram, shape, features.

Points: key columns, x, y, z and colour slots r, g, b. Statistics of a group come from two
aggregations with map-side partials, moments and bins; only extents along a group's own axes take a second pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelflow.functions import geometry as g
from voxelflow.operators.lineage import cut

BINS = 17
LAYOUT = 14 + 3 * BINS
_SCATTER = ("xx", "xy", "xz", "yy", "yz", "zz")
_HIST = [f"h{i}" for i in range(3 * BINS)]


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the columns of ``right`` by keys, in which a null equals a null."""
    renamed = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = reduce(lambda a, c: a & c, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_k_{k}" for k in keys])


def at_least(points: DataFrame, keys: list[str], size: int = 10) -> DataFrame:
    """Groups with ``size`` points or more, and their size n."""
    return points.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= size)


def keep_large(points: DataFrame, keys: list[str], size: int = 10) -> DataFrame:
    """The points of large groups."""
    return joined(points, at_least(points, keys, size).select(*keys), keys, "left_semi")


def majority_label(members: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """The most frequent label >= 0 of each group, ties to the smallest; -1 where there is none."""
    counted = members.groupBy(*keys, label).agg(F.count("*").alias("n"))
    best = F.max(F.when(F.col(label) >= 0, F.struct(F.col("n"), (-F.col(label)).alias("m"))))
    return counted.groupBy(*keys).agg(F.coalesce(-best["m"], F.lit(-1)).cast("int").alias("label"))


def majority_of_spaces(members: DataFrame, keys: list[str]) -> DataFrame:
    """Majority label from a group's image points if it has any, else from its voxel points.
    members: keys, space ('image' or 'voxel'), label."""
    counted = members.groupBy(*keys, "space", "label").agg(F.count("*").alias("n"))
    best = lambda space: F.max(F.when((F.col("space") == space) & (F.col("label") >= 0), F.struct(F.col("n"), (-F.col("label")).alias("m"))))
    has = F.count_if(F.col("space") == "image") > 0
    return counted.groupBy(*keys).agg(F.when(has, F.coalesce(-best("image")["m"], F.lit(-1))).otherwise(F.coalesce(-best("voxel")["m"], F.lit(-1))).cast("int").alias("label"))


def histogram_bins(r: Column, green: Column, b: Column, compat: bool = False) -> list[Column]:
    """The bins a point counts in, one for each slot. compat: the bin of the second and third slot
    is clamped to 17 as well, so all their points count there."""
    one = lambda c: F.floor(c / BINS).cast("int")
    if compat:
        return [F.least(one(r), F.lit(BINS)), F.least(one(green) + BINS, F.lit(BINS)), F.least(one(b) + 2 * BINS, F.lit(BINS))]
    return [F.least(one(r), F.lit(BINS - 1)), F.least(one(green), F.lit(BINS - 1)) + BINS, F.least(one(b), F.lit(BINS - 1)) + 2 * BINS]


def statistics(points: DataFrame, keys: list[str], compat: bool = False) -> DataFrame:
    """n, centroid mx my mz, scatter xx..zz about it, histogram counts h0..h50."""
    n = F.count("*")
    bins = histogram_bins(F.col("r"), F.col("g"), F.col("b"), compat)
    scatter = [(F.covar_pop(k[0], k[1]) * n).alias(k) for k in _SCATTER]
    moments = points.groupBy(*keys).agg(n.alias("n"), *[F.avg(c).alias(f"m{c}") for c in "xyz"], *scatter)
    counted = points.select(*keys, F.explode(F.array(*bins)).alias("bin")).where("bin is not null").groupBy(*keys, "bin").agg(n.alias("m"))
    held = counted.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "m"))).alias("_h"))  # one entry a bin at most
    both = joined(moments, held, keys, "left")
    return both.select(*moments.columns, *[F.coalesce(F.col("_h")[i], F.lit(0)).cast("long").alias(f"h{i}") for i in range(3 * BINS)])


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of unions of groups from the statistics of the groups: no point is read again."""
    n = F.sum("n")
    total = parts.groupBy(*keys).agg(n.alias("n"), *[(F.sum(F.col("n") * F.col(f"m{c}")) / n).alias(f"m{c}") for c in "xyz"], *[F.sum(k).alias(k) for k in _HIST])
    means = total.select(*keys, *[F.col(f"m{c}").alias(f"t{c}") for c in "xyz"])
    shifted = joined(parts, means, keys)
    d = {c: F.col(f"m{c}") - F.col(f"t{c}") for c in "xyz"}
    scatter = shifted.groupBy(*keys).agg(*[F.sum(F.col(p) + F.col("n") * d[p[0]] * d[p[1]]).alias(p) for p in _SCATTER])
    return joined(total, scatter, keys)


def shape(stats: DataFrame, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Adds l0 l1 l2 (eigenvalues), sigma_p, sigma_s, sigma_l, curvature, axes a0* a1* a2*, the normal
    nx ny nz (pointing away from the sensor), nah and tah. The third axis has z >= 0."""
    s = tuple(F.col(k) for k in _SCATTER)
    with_l = stats.withColumns(dict(zip(("l0", "l1", "l2"), g.eigenvalues(s), strict=True)))
    l0, l1, l2 = F.col("l0"), F.col("l1"), F.col("l2")
    total = l0 + l1 + l2
    with_l = with_l.withColumns({"sigma_p": l0, "sigma_s": l1 - l0, "sigma_l": l2 - l1, "curvature": F.when(total > 0, l0 / total).otherwise(0.0)})
    low, high = g.eigenvector(s, l0, (0, 0, 1)), g.eigenvector(s, l2, (1, 0, 0))
    axes = with_l.withColumns({f"a0{c}": v for c, v in zip("xyz", low, strict=True)} | {f"u2{c}": v for c, v in zip("xyz", high, strict=True)})
    up = F.col("u2z") < 0
    axes = axes.withColumns({f"a2{c}": F.when(up, -F.col(f"u2{c}")).otherwise(F.col(f"u2{c}")) for c in "xyz"}).drop("u2x", "u2y", "u2z")
    a0, a2 = tuple(F.col(f"a0{c}") for c in "xyz"), tuple(F.col(f"a2{c}") for c in "xyz")
    axes = axes.withColumns({f"a1{c}": v for c, v in zip("xyz", g.cross(a2, a0), strict=True)})
    away = g.dot(tuple(F.col(f"m{c}") - o for c, o in zip("xyz", origin, strict=True)), a0)
    axes = axes.withColumns({f"n{c}": F.when(away < 0, -F.col(f"a0{c}")).otherwise(F.col(f"a0{c}")) for c in "xyz"})
    most = F.greatest("sigma_l", "sigma_p", "sigma_s")
    return axes.withColumns({"nah": F.when(most > 0, F.col("nz") * F.col("sigma_l") / most).otherwise(0.0), "tah": F.when(most > 0, F.col("a2z") * F.col("sigma_s") / most).otherwise(0.0)})


_AXES = [f"a{i}{c}" for i in range(3) for c in "xyz"]


def _along() -> list[Column]:
    p = (F.col("x"), F.col("y"), F.col("z"))
    return [g.dot(p, tuple(F.col(f"a{i}{c}") for c in "xyz")) for i in range(3)]


def extents(points: DataFrame, shaped: DataFrame, keys: list[str]) -> DataFrame:
    """bb1 bb2 bb3: extent of each group's points along its axes."""
    met = joined(points.select(*keys, "x", "y", "z"), shaped.select(*keys, *_AXES), keys)
    return met.groupBy(*keys).agg(*[(F.max(a) - F.min(a)).alias(f"bb{i + 1}") for i, a in enumerate(_along())])


def reaches(points: DataFrame, shaped: DataFrame, keys: list[str], pairs: DataFrame) -> DataFrame:
    """bb1..3, the extents of each group's points along its axes, and n_bb1..3, those of its points
    and of the points of its neighbours. pairs: keys of the group and _of, the neighbour. The axes go
    to the points, once for each neighbour, and only maxima and minima leave the tasks."""
    *scene, vid = keys
    axes = shaped.select(*keys, *_AXES)
    met = axes.withColumns({"_of": F.col(vid), "_self": F.lit(True)}).unionByName(joined(pairs, axes, keys).withColumn("_self", F.lit(False)))
    rows = joined(points.select(*scene, F.col(vid).alias("_of"), "x", "y", "z"), met.withColumnRenamed(vid, "_center"), [*scene, "_of"])
    own = lambda a: F.when(F.col("_self"), a)
    sums = [x for i, a in enumerate(_along()) for x in ((F.max(own(a)) - F.min(own(a))).alias(f"bb{i + 1}"), (F.max(a) - F.min(a)).alias(f"n_bb{i + 1}"))]
    return rows.groupBy(*scene, "_center").agg(*sums).withColumnRenamed("_center", vid)


def _own(prefix: str = "") -> list[Column]:
    c = lambda k: F.col(prefix + k)
    hist = [c(k) / c("n") for k in _HIST]
    return [c("mz"), *hist, c("sigma_p"), c("sigma_s"), c("sigma_l"), c("curvature"), c("nx"), c("ny"), c("nz"), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c("nz")))), c("nah"), c("tah"), c("bb1"), c("bb2"), c("bb3")]


def features(points: DataFrame, keys: list[str], origin: tuple = (0.0, 0.0, 0.0), edges: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """keys, n, features (array<double>): LAYOUT values of each group; with ``edges`` (the keys but
    the last, src, dst) 2 * LAYOUT - 2 values, zero where a group has no neighbour, and
    has_neighbors. The neighbourhood is the group's points and, for each edge, its neighbour's;
    compat: for each edge the group's own points again, and two entries as literally written
    (index 119 the plain sigma_l, index 122 zero). A null key is a group of its own."""
    *scene, vid = keys
    own_stats = cut(statistics(points, keys, compat))
    shaped = shape(own_stats, origin)
    if edges is None:
        return joined(shaped, extents(points, shaped, keys), keys).select(*keys, "n", F.array(*_own()).alias("features"))
    pairs = edges.select(*scene, F.col("src").alias(vid), F.col("src" if compat else "dst").alias("_of"))
    stats = own_stats.select(*scene, F.col(vid).alias("_of"), *[c for c in own_stats.columns if c not in keys])
    around = own_stats.unionByName(joined(pairs, stats, [*scene, "_of"]).drop("_of"))
    around = joined(around, pairs.select(*keys).distinct(), keys, "left_semi")
    near = shape(merged(around, keys), origin)
    near = near.select(*keys, *[F.col(c).alias(f"n_{c}") for c in near.columns if c not in keys])
    both = joined(joined(shaped, reaches(points, shaped, keys, pairs), keys), near, keys, "left")
    a, b = _own(), _own("n_")
    turn = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), g.dot(tuple(F.col(f"n{c}") for c in "xyz"), tuple(F.col(f"n_n{c}") for c in "xyz")))))
    differ = lambda i: b[i] - a[i]
    sigma_l = F.col("sigma_l") if compat else differ(54)
    slope = F.lit(0.0) if compat else differ(59)
    more = [b[0], *[differ(i) for i in range(1, 54)], sigma_l, differ(55), turn, slope, *[differ(i) for i in range(60, 65)]]
    return both.select(*keys, "n", F.col("n_n").isNotNull().alias("has_neighbors"), F.array(*a, *[F.coalesce(v, F.lit(0.0)) for v in more]).alias("features"))

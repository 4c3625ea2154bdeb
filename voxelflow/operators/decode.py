"""Joins and projections around the predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def argmax(p: Column) -> Column:
    """Index of the largest value, the first of equals."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def unary_energy(p: Column, least: float = 1e-6) -> Column:
    return F.transform(p, lambda v: -F.ln(F.greatest(v, F.lit(least))))


def label_frequencies(points: DataFrame, keys: list[str], p: str = "prob") -> DataFrame:
    """keys, label, freq: mean probability of each class over the points."""
    return points.select(*keys, F.posexplode(p).alias("label", "v")).groupBy(*keys, "label").agg(F.avg("v").alias("freq"))


def point_index(points: DataFrame, scene: list[str], order: list[str]) -> DataFrame:
    """Adds pidx, a running index from 0 by ``order`` within each scene. Points of one value of the
    first order column are numbered apart and moved by the sizes of those before them, so no task
    holds a whole scene. Nulls come first, in scenes of their own where a scene is null."""
    at = [*scene, order[0]]
    sizes = points.groupBy(*at).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*scene).orderBy(order[0]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    moved = sizes.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(at)], before.alias("_before"))
    within = points.withColumn("_within", F.row_number().over(W.partitionBy(*at).orderBy(*order)))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(at)])
    return within.join(moved, same).select(*points.columns, (F.col("_before") + F.col("_within") - 1).alias("pidx"))


def scatter_default(grid: DataFrame, values: DataFrame, keys: list[str], defaults: dict) -> DataFrame:
    """Every grid cell with its value or the default."""
    found = grid.join(values, keys, "left")
    return found.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def existing_only(image_points: DataFrame, voxels: DataFrame, keys: list[str]) -> DataFrame:
    """Image points whose voxel exists."""
    return image_points.join(voxels.select(*keys).distinct(), keys, "left_semi")


def jitter_expand(scenes: DataFrame, jitters: tuple[float, ...] = (-0.05, -0.025, 0.0, 0.025, 0.05), seed_resolution: float = 0.2) -> DataFrame:
    """Each row once for each jitter: jitter_no, seed_resolution."""
    each = F.posexplode(F.array(*[F.lit(seed_resolution + j) for j in jitters])).alias("jitter_no", "seed_resolution")
    return scenes.select("*", each)


def accumulate_jitters(members: DataFrame, jitters: int = 5) -> DataFrame:
    """Members of jitter k counted in all later jitters too (one map for all jitters, never cleared)."""
    return members.withColumn("jitter_no", F.explode(F.sequence("jitter_no", F.lit(jitters - 1))))


def rescale(rows: DataFrame, column: str, out: str = "scaled") -> DataFrame:
    """Linear rescaling of a column to 0..255 by its global extremes."""
    ends = rows.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))  # one row
    whole = rows.crossJoin(F.broadcast(ends))
    return whole.withColumn(out, F.when(F.col("_hi") > F.col("_lo"), (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 255.0).otherwise(0.0)).drop("_lo", "_hi")


def response(points: DataFrame, frequencies: DataFrame) -> DataFrame:
    """One row per waypoint with parallel arrays: label, label_probabilities (flat), points,
    label_frequencies. points: waypoint_id, pidx, x, y, z, label, prob."""
    packed = points.groupBy("waypoint_id").agg(F.array_sort(F.collect_list(F.struct("pidx", "label", "prob", F.struct("x", "y", "z").alias("point")))).alias("p"))
    freq = frequencies.groupBy("waypoint_id").agg(F.array_sort(F.collect_list(F.struct("label", "freq"))).alias("f"))
    return packed.join(freq, "waypoint_id").select("waypoint_id", F.col("p.label").alias("label"), F.flatten("p.prob").alias("label_probabilities"), F.col("f.freq").alias("label_frequencies"), F.col("p.point").alias("points"))


def unpacked_response(packed: DataFrame, classes: int) -> DataFrame:
    """Rows of a response: waypoint_id, no (place in the arrays), x, y, z, label, p0.. and share, the
    frequency of the label in its waypoint."""
    rows = packed.select("waypoint_id", "label_probabilities", "label_frequencies", F.posexplode(F.arrays_zip("points", "label")).alias("no", "e"))
    prob = [F.get("label_probabilities", F.col("no") * classes + c).alias(f"p{c}") for c in range(classes)]
    return rows.select("waypoint_id", "no", "e.points.*", F.col("e.label").alias("label"), *prob, F.get("label_frequencies", F.col("e.label").cast("int")).alias("share"))

"""Kernel densities of clouds and the divergence of one cloud from another.

A cloud's density at a point is the mean of Gaussian kernels of width ``h`` at the cloud's points. Points
are summed in cells of a fraction of h first, and a cell stands at its mean: with cells of side h / 4 the
kernel sums of a cell are off by at most a part in 40 of the largest kernel value for each point (the
first-order term vanishes at the mean, the second derivatives are at most 1 / h^2, and the squared
distance from the mean is 3 (h / 8)^2 / h^2 on average at most). Cells farther than REACH * h are left
out, each of whose points has less than exp(-REACH^2 / 2) of the largest value. Cells are dealt to the
27 coarse cells around theirs, so a point meets those within reach by one equi-join."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REACH, FINE = 4.0, 0.25


def cells(cloud: DataFrame, h: float, keys: list[str] | None = None, fine: float = FINE) -> DataFrame:
    """keys, n and mean x, y, z of the cloud's cells; points without coordinates have none."""
    cell = [F.floor(F.col(c) / (h * fine)).alias(f"_{c}") for c in "xyz"]
    rows = cloud.where("x is not null and y is not null and z is not null").select(*(keys or []), *cell, "x", "y", "z")
    return rows.groupBy(*(keys or []), "_x", "_y", "_z").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in "xyz"]).drop("_x", "_y", "_z")


def density(points: DataFrame, cloud: DataFrame, h: float, id: str, fine: float = FINE) -> DataFrame:
    """id, density of ``cloud`` at the points (id, x, y, z; ids unique); 0 where nothing of the cloud is near."""
    wide = h * REACH
    held = cells(cloud, h, fine=fine)
    total = held.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))  # one row
    steps = F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(s, "abc", strict=True)]) for s in itertools.product((-1, 0, 1), repeat=3)]))
    there = held.select("n", *[F.col(c).alias(f"m{c}") for c in "xyz"], steps.alias("s"))
    there = there.select("n", "mx", "my", "mz", *[(F.floor(F.col(f"m{c}") / wide) + F.col(f"s.{k}")).alias(f"g{c}") for c, k in zip("xyz", "abc", strict=True)])
    here = points.select(id, "x", "y", "z", *[F.floor(F.col(c) / wide).alias(f"g{c}") for c in "xyz"])
    off = sum(((F.col(c) - F.col(f"m{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    met = here.join(there, ["gx", "gy", "gz"]).withColumn("_off", off).where(F.col("_off") <= wide * wide)
    sums = met.groupBy(id).agg(F.sum(F.col("n") * F.exp(-F.col("_off") / (2 * h * h))).alias("_s"))
    whole = points.select(id).join(sums, id, "left").crossJoin(F.broadcast(total))
    return whole.select(id, F.coalesce(F.col("_s") / (F.col("total") * ((2 * math.pi) ** 1.5 * h**3)), F.lit(0.0)).alias("density"))


def divergence(a: DataFrame, b: DataFrame, h: float, id: str, floor: float = 1e-9, fine: float = FINE) -> DataFrame:
    """One row: n and kl, the mean over the points of ``a`` of ln(density of a / density of b), each at
    least ``floor``: an estimate of the Kullback-Leibler divergence. Points without coordinates don't count."""
    points = a.where("x is not null and y is not null and z is not null")
    own = density(points, a, h, id, fine).withColumnRenamed("density", "pa")
    other = density(points, b, h, id, fine).withColumnRenamed("density", "pb")
    ratio = F.ln(F.greatest("pa", F.lit(floor)) / F.greatest("pb", F.lit(floor)))
    return own.join(other, id).agg(F.count("*").alias("n"), F.avg(ratio).alias("kl"))

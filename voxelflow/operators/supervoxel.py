"""Supervoxels by voxel-cloud connectivity: a grid of voxels, seeds, and rounds in which labels
spread to adjacent voxels and every voxel keeps the nearest of the seeds that reached it, by place,
colour and surface normal.

A cloud from several views lies in a grid of equal cells. A cloud seen by a single ``camera`` at the
origin, looking along z, lies in cells that grow with depth: equal steps of x / z, y / z and the
logarithm of z, so that a voxel covers about as many pixels near and far. Points that such a camera
can't see (z not above 0) have no cell, as points without coordinates."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxelflow.functions import geometry as g
from voxelflow.operators.lineage import cut

CELL = ["i", "j", "k"]
SCATTER = ("xx", "xy", "xz", "yy", "yz", "zz")


def cells(resolution: float, camera: bool = False) -> list[Column]:
    """The cell of a point x, y, z in a grid of equal cells or that of a camera."""
    x, y, z = (F.col(c) for c in "xyz")
    seen = F.when(z > 0, z)
    place = (x / seen, y / seen, F.ln(seen)) if camera else (x, y, z)
    return [F.floor(v / resolution).alias(k) for v, k in zip(place, CELL, strict=True)]


def voxel_grid(points: DataFrame, resolution: float, camera: bool = False, scatter: bool = False) -> DataFrame:
    """scene, i, j, k, n and means of the points in each voxel, with ``scatter`` also the sums of
    products of their distances from the mean."""
    sums = [(F.covar_pop(c[0], c[1]) * F.count("*")).alias(c) for c in SCATTER] if scatter else []
    rows = points.select("scene", *cells(resolution, camera), "x", "y", "z", "r", "g", "b")
    return rows.groupBy("scene", *CELL).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("x", "y", "z", "r", "g", "b")], *sums)


def voxel_normals(voxels: DataFrame, touch: DataFrame) -> DataFrame:
    """scene, i, j, k, nx, ny, nz: the unit normal of the points in each voxel and in those two steps
    away at most, turned towards the origin, where the sensor stands. voxels: with scatter; touch:
    their adjacency. Points are read once: what the voxels hold, count, mean and scatter, is merged
    along the graph, about each voxel's own mean, so that nothing cancels. The normal is null where
    the points don't lie on a surface: fewer than three, or no least direction."""
    second = touch.alias("a").join(touch.select("scene", *[F.col(f"{k}").alias(f"{k}2") for k in CELL], *[F.col(f"{k}2").alias(f"{k}3") for k in CELL]), ["scene", *[f"{k}2" for k in CELL]])
    second = second.select("scene", *CELL, *[F.col(f"{k}3").alias(f"{k}2") for k in CELL])
    own = voxels.where("i is not null and j is not null and k is not null").select("scene", *CELL, *[F.col(k).alias(f"{k}2") for k in CELL])
    pairs = touch.select("scene", *CELL, *[f"{k}2" for k in CELL]).union(second).union(own).distinct()
    there = voxels.select("scene", *[F.col(k).alias(f"{k}2") for k in CELL], "n", *[F.col(c).alias(f"o{c}") for c in "xyz"], *SCATTER)
    here = voxels.select("scene", *CELL, *[F.col(c).alias(f"m{c}") for c in "xyz"])
    near = pairs.join(there, ["scene", *[f"{k}2" for k in CELL]]).join(here, ["scene", *CELL]).withColumns({f"d{c}": F.col(f"o{c}") - F.col(f"m{c}") for c in "xyz"})
    moments = near.groupBy("scene", *CELL).agg(
        F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(f"d{c}")).alias(f"s{c}") for c in "xyz"], *[F.sum(F.col(p) + F.col("n") * F.col(f"d{p[0]}") * F.col(f"d{p[1]}")).alias(p) for p in SCATTER],
        *[F.first(f"m{c}").alias(f"m{c}") for c in "xyz"],
    )
    moments = moments.withColumns({p: F.col(p) - F.col(f"s{p[0]}") * F.col(f"s{p[1]}") / F.col("n") for p in SCATTER})
    flat = tuple(F.col(p) for p in SCATTER)
    low, middle, high = g.eigenvalues(flat)
    moments = moments.withColumns({"l0": low, "l1": middle, "l2": high})
    v = g.eigenvector(flat, F.col("l0"), (0, 0, -1))
    moments = moments.withColumns(dict(zip(("vx", "vy", "vz"), v, strict=True)))
    away = g.dot(tuple(F.col(f"v{c}") for c in "xyz"), tuple(F.col(f"m{c}") + F.col(f"s{c}") / F.col("n") for c in "xyz")) > 0
    surface = (F.col("n") >= 3) & (F.col("l1") - F.col("l0") > 1e-6 * (F.col("l0") + F.col("l1") + F.col("l2")))
    return moments.select("scene", *CELL, *[F.when(surface, F.when(away, -F.col(f"v{c}")).otherwise(F.col(f"v{c}"))).alias(f"n{c}") for c in "xyz"])


def adjacency(voxels: DataFrame, names: tuple[str, ...] = ()) -> DataFrame:
    """scene, i, j, k, i2, j2, k2 of occupied voxels that touch (26 neighbours)."""
    near = [d for d in itertools.product((-1, 0, 1), repeat=3) if any(d)]
    steps = F.explode(F.array(*[F.struct(*[F.lit(x).alias(a) for a, x in zip("abc", d, strict=True)]) for d in near]))
    left = voxels.select("scene", *CELL).withColumn("d", steps)
    left = left.select("scene", *CELL, (F.col("i") + F.col("d.a")).alias("i2"), (F.col("j") + F.col("d.b")).alias("j2"), (F.col("k") + F.col("d.c")).alias("k2"))
    there = voxels.select("scene", *[F.col(c).alias(f"{c}2") for c in CELL])
    return left.join(there, ["scene", "i2", "j2", "k2"])


def numbered(rows: DataFrame, group: list[str], chunk: list[str], order: list[str], out: str) -> DataFrame:
    """Adds a running number from 1 in each group, by chunk and then order. Chunks are numbered apart
    and moved by the sizes of those before them, so no task holds a whole group."""
    sizes = rows.groupBy(*group, *chunk).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*group).orderBy(*chunk).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(W.partitionBy(*group, *chunk).orderBy(*order))
    both = rows.withColumn("_within", within).join(sizes.select(*group, *chunk, before.alias("_before")), [*group, *chunk])
    return both.withColumn(out, F.col("_before") + F.col("_within")).drop("_before", "_within")


def supervoxels(points: DataFrame, resolution: float = 0.05, seed_resolution: float = 0.2, color: float = 0.2, spatial: float = 1.0, normal: float = 0.5, camera: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points with vid, 0 where no seed reached them; edges scene, src, dst; voxels with vid).
    A vid that the points had before gives way; points without coordinates keep their row and get 0.
    A seed is the voxel nearest to the centre of each seed cell. Seeds are numbered from 1 in each
    scene, so ids fit the 24 bits of an id image as long as a scene has fewer than 2**24 seeds.
    ``color``, ``spatial`` and ``normal`` weigh what a voxel is apart from a supervoxel; voxels without
    a normal are apart by place and colour alone. ``camera``: the grid of a single camera; labels
    go back to all of its points by their cells."""
    voxels = cut(voxel_grid(points, resolution, camera, scatter=normal > 0))
    touch = cut(adjacency(voxels))
    parts = ["x", "y", "z", "r", "g", "b"]
    if normal > 0:
        voxels = cut(voxels.join(voxel_normals(voxels, touch), ["scene", *CELL], "left").drop(*SCATTER))
        parts += ["nx", "ny", "nz"]
    seat = [F.floor(F.col(c) / seed_resolution).alias(f"s{c}") for c in "xyz"]
    off = sum(((F.col(c) / seed_resolution - F.floor(F.col(c) / seed_resolution) - 0.5) ** 2 for c in "xyz"), F.lit(0.0))
    placed = voxels.where("x is not null and y is not null and z is not null").select("*", *seat, F.struct(off.alias("o"), *CELL).alias("rank"))
    seeds = placed.groupBy("scene", "sx", "sy", "sz").agg(F.min_by(F.struct(*CELL, *parts), "rank").alias("v")).select("scene", "sx", "sy", "sz", "v.*")
    seeds = cut(numbered(seeds, ["scene"], ["sx"], ["sy", "sz"], "id").drop("sx", "sy", "sz"))
    now = cut(voxels.join(seeds.select("scene", *CELL, F.col("id").alias("vid")), ["scene", *CELL], "left"))
    centres = cut(seeds.select("scene", F.col("id").alias("vid"), *[F.col(c).alias(f"m{c}") for c in parts]))
    for _ in range(math.ceil(1.8 * seed_resolution / resolution)):
        offers = touch.join(now.where("vid is not null").select("scene", *[F.col(c).alias(f"{c}2") for c in CELL], F.col("vid").alias("offer")), ["scene", "i2", "j2", "k2"]).select("scene", *CELL, "offer")
        offers = offers.union(now.where("vid is not null").select("scene", *CELL, "vid")).distinct()
        far = sum(((F.col(c) - F.col(f"m{c}")) ** 2 for c in "xyz"), F.lit(0.0)) * (spatial / (3 * seed_resolution**2)) + sum(((F.col(c) - F.col(f"m{c}")) ** 2 for c in "rgb"), F.lit(0.0)) * (color / 255.0**2)
        if normal > 0:
            n, m = (tuple(F.col(f"{p}{c}") for c in "xyz") for p in ("n", "mn"))
            far = far + normal * F.coalesce(1 - F.abs(g.dot(n, m)) / F.sqrt(F.nullif(g.dot(m, m), F.lit(0.0))), F.lit(0.0))
        rated = now.drop("vid").join(offers, ["scene", *CELL]).join(centres.withColumnRenamed("vid", "offer"), ["scene", "offer"]).withColumn("far", far)
        best = rated.groupBy("scene", *CELL).agg(F.min_by("offer", F.struct("far", "offer")).alias("vid"))
        now = cut(now.drop("vid").join(best, ["scene", *CELL], "left"))
        centres = cut(now.where("vid is not null").groupBy("scene", "vid").agg(*[F.avg(c).alias(f"m{c}") for c in parts]))
    labelled = now.select("scene", *CELL, F.coalesce("vid", F.lit(0)).alias("vid"))
    cell = {f"_{k}": v for v, k in zip(cells(resolution, camera), CELL, strict=True)}
    keyed = labelled.select(F.col("scene").alias("_scene"), *[F.col(k).alias(f"_{k}") for k in CELL], F.col("vid").alias("_vid"))
    out = points.drop("vid").withColumns({"_scene": F.col("scene")} | cell).join(keyed, ["_scene", *[f"_{k}" for k in CELL]], "left")
    out = out.withColumn("vid", F.coalesce("_vid", F.lit(0))).select(*points.drop("vid").columns, "vid")
    src = labelled.withColumnRenamed("vid", "src")
    dst = labelled.select("scene", *[F.col(c).alias(f"{c}2") for c in CELL], F.col("vid").alias("dst"))
    edges = touch.join(src, ["scene", *CELL]).join(dst, ["scene", "i2", "j2", "k2"]).where("src <> dst and src > 0 and dst > 0").select("scene", "src", "dst").distinct()
    return out, edges, labelled

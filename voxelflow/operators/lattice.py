"""Gaussian filtering of high-dimensional points in linear time, on the permutohedral lattice.

A point of d features lies in a simplex of d + 1 lattice vertices and splats its values to them with
barycentric weights; the vertices' sums are blurred by (1/2, 1, 1/2) along each of the d + 1 lattice
directions; the point slices its vertices with the same weights (Adams, Baek and Davis, 2010).
Features are in units of the Gaussian's standard deviation.

Splat and slice make d + 1 rows a point. Splat sums are partial, so a crowded vertex is no hot spot.
Vertices on one line of a direction follow each other by one, so a blur is a window over lines with
the row before and the row after: one shuffle of the vertices, no join. As usual for this
filter, only vertices that a point touched take part.

Defined cases: a point with a null, infinite or undefined feature touches no vertex and gets no row;
null values count as 0; points of one place share their vertices; an empty table gives an
empty result."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def coordinates(dims: int) -> list[str]:
    """Columns that name a vertex; its last coordinate is minus their sum."""
    return [f"c{i}" for i in range(dims)]


def corners_of(f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinates [point, corner, d] and weights [point, corner] of the vertices around each point,
    and the share of a point's own values that comes back to it."""
    count, d = f.shape
    n = d + 1
    # onto the plane whose coordinates sum to zero, scaled to the blur's deviation
    s = f * np.array([n * math.sqrt(2 / 3) / math.sqrt((i + 1) * (i + 2)) for i in range(d)])
    lifted = np.stack([sum((s[:, k] for k in range(i, d)), np.zeros(count)) - (i * s[:, i - 1] if i else 0.0) for i in range(n)], 1)
    # the nearest point all of whose coordinates are multiples of n, and the order of the rest
    near = np.floor(lifted / n + 0.5)
    off = lifted - near * n
    rank = np.stack([sum((off[:, j] >= off[:, i] if j < i else off[:, j] > off[:, i]).astype(np.int64) for j in range(n) if j != i) for i in range(n)], 1)
    rank += near.sum(1, dtype=np.int64)[:, None]
    turn = np.where(rank < 0, 1, np.where(rank > d, -1, 0))
    rank, near = rank + turn * n, (near.astype(np.int64) + turn) * n
    v = -np.sort(-(lifted - near) / n, axis=1)
    weight = np.stack([1 + v[:, d] - v[:, 0], *[v[:, d - k] - v[:, d + 1 - k] for k in range(1, n)]], 1)
    place = np.stack([near[:, :d] + np.where(rank[:, :d] <= d - k, k, k - n) for k in range(n)], 1)
    # corners k and l stand |k - l| steps apart; around the other way it is the rest of the d + 1
    way = [1 + 2 * 0.5**n, *[0.5**m + 0.5 ** (n - m) for m in range(1, n)]]
    steps = np.array([[way[abs(k - m)] for m in range(n)] for k in range(n)])
    return place, weight, np.einsum("pk,kl,pl->p", weight, steps, weight)


def simplex(points: DataFrame, feature: str, dims: int) -> DataFrame:
    """Adds ``corner``, the d + 1 vertices around each point (struct of coordinates and weight w), and
    ``alone``, the share of its own values that comes back to the point."""
    usable = f"coalesce(size({feature}) >= {dims} and not exists({feature}, x -> x is null or isnan(x) or abs(x) = double('Infinity')), false)"
    rows = points.withColumn(feature, F.slice(F.col(feature).cast("array<double>"), 1, dims)).where(usable)
    at, names = rows.columns.index(feature), coordinates(dims)
    kind = T.ArrayType(T.StructType([*[T.StructField(c, T.LongType()) for c in names], T.StructField("w", T.DoubleType())]))
    schema = T.StructType([*rows.schema.fields, T.StructField("corner", kind), T.StructField("alone", T.DoubleType())])

    def of(batches):
        for batch in batches:
            place, weight, alone = corners_of(batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
            flat = place.reshape(-1, dims)
            corner = pa.StructArray.from_arrays([*[pa.array(np.ascontiguousarray(flat[:, i])) for i in range(dims)], pa.array(weight.reshape(-1))], names=[*names, "w"])
            ends = pa.array(np.arange(0, len(flat) + 1, dims + 1, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, corner), pa.array(alone)], names=[*batch.schema.names, "corner", "alone"])

    return rows.mapInArrow(of, schema)


def splat(corners: DataFrame, values: list[Column], dims: int) -> DataFrame:
    """scene, coordinates, n and v0..: weights and weighted values summed at each vertex. corners:
    what ``simplex`` gives, with column scene."""
    names = [f"v{i}" for i in range(len(values))]
    rows = corners.select("scene", *[v.alias(c) for v, c in zip(values, names, strict=True)], F.explode("corner").alias("c")).select("scene", "c.*", *names)
    return rows.groupBy("scene", *coordinates(dims)).agg(F.sum("w").alias("n"), *[F.sum(F.col("w") * F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in names])


def blur(vertices: DataFrame, dims: int) -> DataFrame:
    """The vertices with n and v0.. blurred along every direction."""
    keys = coordinates(dims)
    values = [c for c in vertices.columns if c not in ("scene", *keys)]
    every = [*[F.col(c) for c in keys], -sum((F.col(c) for c in keys[1:]), F.col(keys[0]))]
    for j in range(dims + 1):
        lead = 1 if j == 0 else 0
        line = [(every[i] - every[lead]).alias(f"_l{i}") for i in range(dims + 1) if i not in (j, lead)]
        lined = vertices.select("*", *line, every[lead].alias("_p"))
        w = W.partitionBy("scene", *[f"_l{i}" for i in range(dims + 1) if i not in (j, lead)]).orderBy("_p")
        beside = lined.withColumns({"_a": F.lag(F.struct("_p", *values)).over(w), "_z": F.lead(F.struct("_p", *values)).over(w)})
        near = lambda c: F.when(F.col("_a._p") == F.col("_p") - 1, F.col(f"_a.{c}")).otherwise(0.0) + F.when(F.col("_z._p") == F.col("_p") + 1, F.col(f"_z.{c}")).otherwise(0.0)
        vertices = beside.select("scene", *keys, *[(F.col(c) + 0.5 * near(c)).alias(c) for c in values])
    return vertices


def lattice_messages(points: DataFrame, feature: str, classes: int, dims: int, q: str = "q") -> DataFrame:
    """scene, pidx, m0..: the kernel-weighted mean of the other points' marginals ``q``; 0 where no
    other point is near."""
    corners = simplex(points.select("scene", "pidx", feature, q), feature, dims)
    around = blur(splat(corners, [F.get(q, F.lit(c)) for c in range(classes)], dims), dims)
    mine = corners.select("scene", "pidx", q, "alone", F.explode("corner").alias("c")).select("scene", "pidx", q, "alone", "c.*")
    sliced = mine.join(around, ["scene", *coordinates(dims)]).groupBy("scene", "pidx").agg(
        F.sum(F.col("w") * F.col("n")).alias("n"), *[F.sum(F.col("w") * F.col(f"v{c}")).alias(f"v{c}") for c in range(classes)], F.first(q).alias(q), F.first("alone").alias("alone")
    )
    rest = F.col("n") - F.col("alone")
    mean = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(f"v{c}") - F.col("alone") * F.get(q, F.lit(c))) / rest))
    return sliced.select("scene", "pidx", *[F.when(rest > 1e-6, mean(c)).otherwise(0.0).alias(f"m{c}") for c in range(classes)])

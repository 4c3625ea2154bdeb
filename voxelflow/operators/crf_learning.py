"""Learning a CRF's kernel weights and compatibility from labelled points.

One mean-field step from the class probabilities p gives marginals q = softmax(ln p + sum over kernels of
weight * (messages . compatibility)), where the messages are the kernels' weighted means of the other
points' p. They don't depend on what is learnt, so they are computed once; the mean log probability of
the true labels and its gradient are then one aggregation each time. The driver holds a vector of two
weights and a matrix of classes by classes, and climbs by L-BFGS with backtracking. A small quadratic
penalty around the start (unit compatibility) fixes the scale that weights and compatibility share.

Defined cases: points without a label in [0, classes) give messages but no likelihood; without any
labelled point the start is returned; points without a message of a kernel get zeros from it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelflow.operators import crf
from voxelflow.operators.lineage import cut

KERNELS = ("f6", "f3")


@dataclass
class Learnt:
    weights: np.ndarray  # appearance, smoothness
    compatibility: np.ndarray  # [of the point, of its neighbours]
    history: list[float]  # mean log likelihood after each step, the start first


def with_messages(points: DataFrame, classes: int, dims: tuple[int, int] = (6, 3), method: str = "lattice") -> DataFrame:
    """scene, pidx, label, p and the kernels' messages a (appearance) and s (smoothness)."""
    rows = points.select("scene", "pidx", "label", "p")
    for feature, d, name in zip(KERNELS, dims, "as", strict=True):
        m = crf.messages(points, feature, classes, d, method, "p").select("scene", "pidx", F.array(*[f"m{c}" for c in range(classes)]).alias(name))
        rows = rows.join(m, ["scene", "pidx"], "left").withColumn(name, F.coalesce(name, F.array(*[F.lit(0.0)] * classes)))
    return cut(rows)


def _dot(m: str, row: np.ndarray) -> Column:
    return sum((F.get(m, F.lit(k)) * float(v) for k, v in enumerate(row)), F.lit(0.0))


def likelihood(rows: DataFrame, weights: np.ndarray, compatibility: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, int]:
    """Mean log likelihood of the labelled rows, its gradient by weights and by compatibility, their number."""
    n = len(compatibility)
    labelled = rows.where((F.col("label") >= 0) & (F.col("label") < n))
    mixed = [F.array(*[_dot(m, compatibility[c]) for c in range(n)]).alias(f"{m}c") for m in "as"]
    labelled = labelled.select("label", "p", "a", "s", *mixed)
    energy = F.array(*[F.ln(F.greatest(F.get("p", F.lit(c)), F.lit(1e-6))) + float(weights[0]) * F.get("ac", F.lit(c)) + float(weights[1]) * F.get("sc", F.lit(c)) for c in range(n)])
    labelled = labelled.withColumn("e", energy).withColumn("top", F.array_max("e"))
    labelled = labelled.withColumn("z", F.aggregate("e", F.lit(0.0), lambda t, v: t + F.exp(v - F.col("top"))))
    off = [F.when(F.col("label") == c, 1.0).otherwise(0.0) - F.exp(F.get("e", F.lit(c)) - F.col("top")) / F.col("z") for c in range(n)]
    labelled = labelled.withColumn("off", F.array(*off))
    sums = [F.count("*").alias("n"), F.sum(F.get("e", F.col("label").cast("int")) - F.col("top") - F.ln("z")).alias("l")]
    for k, m in enumerate("as"):
        sums.append(F.sum(sum((F.get("off", F.lit(c)) * F.get(f"{m}c", F.lit(c)) for c in range(n)), F.lit(0.0))).alias(f"w{k}"))
        sums += [F.sum(F.get("off", F.lit(c)) * F.get(m, F.lit(d))).alias(f"{m}{c}_{d}") for c in range(n) for d in range(n)]
    r = labelled.agg(*sums).head()
    if not r["n"]:
        return 0.0, np.zeros(2), np.zeros((n, n)), 0
    by_pair = sum(w * np.array([[r[f"{m}{c}_{d}"] for d in range(n)] for c in range(n)]) for m, w in zip("as", weights, strict=True))
    return r["l"] / r["n"], np.array([r["w0"], r["w1"]]) / r["n"], by_pair / r["n"], r["n"]


def learn(rows: DataFrame, classes: int, start: tuple[float, float] = (1.0, 1.0), steps: int = 15, penalty: float = 1e-3, memory: int = 5) -> Learnt:
    """Climbs from ``start`` and unit compatibility. rows: see with_messages."""
    origin = np.concatenate([np.asarray(start, float), np.eye(classes).reshape(-1)])

    def value(x: np.ndarray) -> tuple[float, np.ndarray, float]:
        l, by_weight, by_pair, _ = likelihood(rows, x[:2], x[2:].reshape(classes, classes))
        return l - penalty * ((x - origin) ** 2).sum(), np.concatenate([by_weight, by_pair.reshape(-1)]) - 2 * penalty * (x - origin), l

    x = origin.copy()
    f, slope, l = value(x)
    history, moves = [l], []
    for _ in range(steps):
        way, held = slope.copy(), []
        for s, y in reversed(moves):
            a = (s @ way) / (y @ s)
            held.append(a)
            way -= a * y
        if moves:
            s, y = moves[-1]
            way *= (s @ y) / (y @ y)
        for (s, y), a in zip(moves, reversed(held), strict=True):
            way += s * (a - (y @ way) / (y @ s))
        if way @ slope <= 1e-12:
            way = slope.copy()
        size = 1.0
        while size > 1e-6:
            g, new, l = value(x + size * way)
            if g >= f + 1e-4 * size * (way @ slope):
                break
            size /= 2
        else:
            break
        s, y = size * way, slope - new  # of the negated function
        if s @ y > 1e-12:
            moves = [*moves, (s, y)][-memory:]
        x, f, slope = x + size * way, g, new
        history.append(l)
        if abs(slope).max() < 1e-6:
            break
    return Learnt(x[:2], x[2:].reshape(classes, classes), history)

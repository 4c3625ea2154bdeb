"""Growing a forest's trees on binned rows: the wide nodes by histograms, the rest by subtree.

A table of blocks holds the rows: their ids, labels, and each feature as its number of one of BINS
intervals. How often a tree draws a row (Poisson of mean 1, a bootstrap) is a hash of seed, tree and id.
Nodes of more than ``group`` rows are split first: each task counts the rows of its blocks by node,
feature, interval and label, and the counts of a node are added up and its best split is found in one task of
its own. Rows then meet by tree and remaining node, at most ``group`` of them, and the subtree below
grows there at once. So the work of a small node is that of its rows, and nothing grows with the
rows but the number of groups.

The choices are those of Spark's learner: Gini gain, ceil(sqrt(features)) features for each node, splits with too
few rows or no gain are none, and two leaves of one parent and one prediction are their parent (within a group)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BINS = 32
#: Most rows of a tree that one task holds to grow a subtree.
GROUP = 1 << 15
#: Most wide nodes that are counted in one round.
ROUND = 2048
_DRAWN = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])
BLOCK = "ids binary, labels binary, bins binary"
NODE = "tree int, node int, id int, feature int, bin int, left int, right int, stats array<double>, gain double"


@dataclass(frozen=True)
class Shape:
    trees: int
    depth: int
    least: int
    seed: int
    features: int
    classes: int
    group: int = GROUP


def drawn(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often the tree draws each row."""
    x = ids.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (tree + 1) + 0xD1342543DE82EF95 * (seed + 1)) % (1 << 64))
    for _ in range(2):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return np.searchsorted(_DRAWN, (x >> np.uint64(11)) * 2.0**-53, side="right").astype(np.uint8)


def chosen(rng: np.random.Generator, nodes: int, features: int) -> np.ndarray:
    """[nodes, k] the features that each node looks at."""
    return rng.random((nodes, features)).argsort(1)[:, : math.ceil(math.sqrt(features))]


def counted(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, slot: np.ndarray, of: np.ndarray, classes: int) -> np.ndarray:
    """[class, node, feature, interval] numbers of rows; slot: each row's node, of: the nodes' features."""
    nodes, k = of.shape
    picked = bins[np.arange(len(bins))[:, None], of[slot]]
    code = ((label[:, None] * nodes + slot[:, None]) * k + np.arange(k)) * BINS + picked
    return np.bincount(code.ravel(), np.repeat(weight, k), classes * nodes * k * BINS).reshape(classes, nodes, k, BINS)


def best_splits(counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node the place of its feature, the last interval on the left and the gain (0: no split)."""
    left = counts.cumsum(3)[..., :-1]
    total = counts[:, :, 0].sum(2)
    n, (nl, sl) = total.sum(0), (left.sum(0), np.einsum("cnfb,cnfb->nfb", left, left))
    right = np.subtract(total[:, :, None, None], left, out=left)
    nr, sr = right.sum(0), np.einsum("cnfb,cnfb->nfb", right, right)
    gain = (sl / np.maximum(nl, 1) + sr / np.maximum(nr, 1)) / n[:, None, None] - ((total * total).sum(0) / n**2)[:, None, None]
    gain[(nl < least) | (nr < least) | (gain < 1e-12)] = 0
    at = gain.reshape(len(n), -1).argmax(1)
    return at // (BINS - 1), at % (BINS - 1), gain.reshape(len(n), -1)[np.arange(len(n)), at]


def subtree(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, shape: Shape, depth: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """The nodes below and with a node of these rows, in the order of levels: feature (-1: a leaf), bin, left, right, stats, gain."""
    slot, n, levels, parts = np.zeros(len(bins), np.int64), 1, [], []
    step = max(1, (1 << 20) // (math.ceil(math.sqrt(shape.features)) * BINS * shape.classes))
    weight = weight.astype(np.float64)
    first = 0
    while n:
        stats = np.bincount(slot * shape.classes + label, weight, n * shape.classes).reshape(n, shape.classes)
        feature, cut, gain = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n)
        wanted = np.flatnonzero(((stats > 0).sum(1) > 1) & (stats.sum(1) >= 2 * shape.least)) if len(levels) < depth else np.empty(0, np.int64)
        place = np.full(n, -1)
        place[wanted] = np.arange(len(wanted))
        rows = np.flatnonzero(place[slot] >= 0)
        rows = rows[np.argsort(place[slot[rows]], kind="stable")]
        bins, label, weight, at = bins[rows], label[rows], weight[rows], place[slot[rows]]
        for k in range(0, len(wanted), step):
            some = slice(*np.searchsorted(at, [k, k + step]))
            of = chosen(rng, len(wanted[k : k + step]), shape.features)
            f, b, g = best_splits(counted(bins[some], label[some], weight[some], at[some] - k, of, shape.classes), shape.least)
            here = wanted[k : k + step]
            feature[here], cut[here], gain[here] = np.where(g > 0, of[np.arange(len(of)), f], -1), b, g
        split = np.flatnonzero(feature >= 0)
        left = np.full(n, -1)
        left[split] = first + n + 2 * np.arange(len(split))
        levels.append((first, first + n))
        parts.append((feature, cut, left, np.where(left < 0, -1, left + 1), stats, gain))
        node = wanted[at]
        going = feature[node] >= 0
        bins, label, weight, node = bins[going], label[going], weight[going], node[going]
        slot = left[node] - (first + n) + (bins[np.arange(len(bins)), feature[node]] > cut[node])
        first, n = first + n, 2 * len(split)
    out = dict(zip(("feature", "bin", "left", "right", "stats", "gain"), map(np.concatenate, zip(*parts, strict=True)), strict=True))
    feature, prediction, kept = out["feature"], out["stats"].argmax(1), np.ones(first, bool)
    for start, end in reversed(levels):
        inner = start + np.flatnonzero(feature[start:end] >= 0)
        left, right = out["left"][inner], out["right"][inner]
        same = (feature[left] < 0) & (feature[right] < 0) & (prediction[left] == prediction[right])
        feature[inner[same]] = -1
        kept[left[same]] = kept[right[same]] = False
    number = np.cumsum(kept) - 1
    for side in ("left", "right"):
        out[side] = np.where(feature < 0, -1, number[out[side]])
    out["gain"] = np.where(feature < 0, -1.0, out["gain"])
    return {name: values[kept] for name, values in out.items()}


@dataclass
class Top:
    """The nodes of a tree down to its groups. links: [node] feature (-1: none), bin, left, right."""

    links: list[list[int]] = field(default_factory=lambda: [[-1, 0, -1, -1]])
    level: list[int] = field(default_factory=lambda: [0])
    stats: list[np.ndarray | None] = field(default_factory=lambda: [None])
    gain: list[float] = field(default_factory=lambda: [-1.0])
    done: list[bool] = field(default_factory=lambda: [False])


def routed(bins: np.ndarray, links: np.ndarray) -> np.ndarray:
    """The node of the top that each row comes to."""
    at = np.zeros(len(bins), np.int64)
    while (inner := links[at, 0] >= 0).any():
        feature, cut, left, right = links[at].T
        at = np.where(inner, np.where(bins[np.arange(len(bins)), feature] <= cut, left, right), at)
    return at


def _dealt(batches: Iterator[pa.RecordBatch], shape: Shape, links: list[np.ndarray], trees: list[int]):
    """tree, bins, labels, weights and nodes of the rows that it draws, by block and tree."""
    for batch in batches:
        for row in batch.to_pylist():
            ids, label = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int32)
            bins = np.frombuffer(row["bins"], np.uint8).reshape(len(ids), -1)
            for tree in trees:
                weight = drawn(ids, tree, shape.seed)
                held = np.flatnonzero(weight)
                yield tree, bins[held], label[held], weight[held], routed(bins[held], links[tree])


def _histograms(shape: Shape, links: list[np.ndarray], wide: dict[int, list[int]]) -> Callable:
    def run(batches):
        of = {t: np.concatenate([chosen(np.random.default_rng([shape.seed, t, n]), 1, shape.features) for n in nodes]) for t, nodes in wide.items()}
        place = {t: np.full(len(links[t]), -1) for t in wide}
        for t, nodes in wide.items():
            place[t][nodes] = np.arange(len(nodes))
        sums: dict[int, np.ndarray] = {}
        for tree, bins, label, weight, node in _dealt(batches, shape, links, list(wide)):
            slot = place[tree][node]
            at = np.flatnonzero(slot >= 0)
            found = counted(bins[at], label[at], weight[at], slot[at], of[tree], shape.classes)
            sums[tree] = sums[tree] + found if tree in sums else found
        for tree, found in sums.items():
            for k, node in enumerate(wide[tree]):
                if found[:, k].any():
                    yield pa.RecordBatch.from_pylist([{"tree": tree, "node": node, "counts": found[:, k].tobytes()}], pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("counts", pa.binary())]))

    return run


def _split(shape: Shape) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        tree, node = group["tree"][0].as_py(), group["node"][0].as_py()
        counts = sum(np.frombuffer(x.as_buffer(), np.float64) for x in group["counts"]).reshape(shape.classes, 1, -1, BINS)
        f, b, g = (x[0] for x in best_splits(counts.copy(), shape.least))
        feature = int(chosen(np.random.default_rng([shape.seed, tree, node]), 1, shape.features)[0, f]) if g > 0 else -1
        left = counts[:, 0, f, : b + 1].sum(1)
        return pa.table({"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()), "feature": pa.array([feature], pa.int32()), "bin": pa.array([int(b)], pa.int32()), "left": [left.tolist()], "right": [(counts[:, 0, 0].sum(1) - left).tolist()], "gain": [float(g)]})

    return run


def tops(blocks: DataFrame, rows: int, shape: Shape) -> list[Top]:
    """Every tree's nodes of more than ``group`` rows, split; a small table of nodes, like the forest's root."""
    found = [Top() for _ in range(shape.trees)]
    open_ = [(t, 0) for t in range(shape.trees)] if rows > shape.group else []
    while open_:
        wide: dict[int, list[int]] = {}
        for t, n in open_[:ROUND]:
            wide.setdefault(t, []).append(n)
        open_ = open_[ROUND:]
        counts = blocks.mapInArrow(_histograms(shape, [np.array(x.links) for x in found], wide), "tree int, node int, counts binary")
        for r in counts.groupBy("tree", "node").applyInArrow(_split(shape), "tree int, node int, feature int, bin int, left array<double>, right array<double>, gain double").collect():
            top, node = found[r["tree"]], r["node"]
            sides = [np.array(r["left"]), np.array(r["right"])]
            top.stats[node] = sides[0] + sides[1]
            if r["feature"] < 0:
                top.done[node] = True
                continue
            top.links[node], top.gain[node] = [r["feature"], r["bin"], len(top.links), len(top.links) + 1], r["gain"]
            for stats in sides:
                level, end = top.level[node] + 1, top.level[node] + 1 >= shape.depth or (stats > 0).sum() < 2
                if not end and stats.sum() > shape.group:
                    open_.append((r["tree"], len(top.links)))
                top.links.append([-1, 0, -1, -1])
                top.level.append(level)
                top.stats.append(stats)
                top.gain.append(-1.0)
                top.done.append(bool(end))
    return found


def _by_group(shape: Shape, links: list[np.ndarray], done: list[np.ndarray]) -> Callable:
    schema = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("labels", pa.binary()), ("weights", pa.binary()), ("bins", pa.binary())])

    def run(batches):
        for tree, bins, label, weight, node in _dealt(batches, shape, links, list(range(shape.trees))):
            order = np.argsort(node, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
                if len(at) and not done[tree][node[at[0]]]:
                    yield pa.RecordBatch.from_pylist([{"tree": tree, "node": int(node[at[0]]), "labels": label[at].tobytes(), "weights": weight[at].tobytes(), "bins": bins[at].tobytes()}], schema)

    return run


def _grown(shape: Shape, level: list[np.ndarray]) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        tree, node = group["tree"][0].as_py(), group["node"][0].as_py()
        label, weight, bins = (np.frombuffer(b"".join(group[c].to_pylist()), kind) for c, kind in (("labels", np.int32), ("weights", np.uint8), ("bins", np.uint8)))
        nodes = subtree(bins.reshape(len(label), -1), label, weight, shape, shape.depth - int(level[tree][node]), np.random.default_rng([shape.seed, tree, node, 1]))
        n = len(nodes["feature"])
        whole = {"tree": np.full(n, tree), "node": np.full(n, node), "id": np.arange(n)} | {c: nodes[c] for c in ("feature", "bin", "left", "right")}
        stats = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * shape.classes, nodes["stats"].ravel())
        return pa.table({c: pa.array(v.astype(np.int32)) for c, v in whole.items()} | {"stats": stats, "gain": nodes["gain"]})

    return run


def subtrees(blocks: DataFrame, found: list[Top], shape: Shape) -> DataFrame:
    """The nodes (NODE) of every group; ids count from 0 at the group's root."""
    links, done, level = ([np.array(getattr(x, name)) for x in found] for name in ("links", "done", "level"))
    dealt = blocks.mapInArrow(_by_group(shape, links, done), "tree int, node int, labels binary, weights binary, bins binary")
    return dealt.groupBy("tree", "node").applyInArrow(_grown(shape, level), NODE)

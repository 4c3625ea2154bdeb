"""Hard negatives, window packing and ball k-means against brute force, with odd rows and empty tables."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from voxelflow.llm import ball_kmeans, hard_negatives, window_packing

VECTORS = "vec_id long, embedding array<float>, label int, block long, row long, g int, kind string, slot int"
DOCS = "doc_id long, text string, row long, ids string, length long"
NAN, INF = float("nan"), float("inf")


def vectors(n, d, seed=0, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.2, (labels, d))
    return [(k, (centres[k % labels] + rng.normal(0, 0.1, d)).astype(np.float32).tolist(), int(k % labels)) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "x", 4) for r in rows], VECTORS).repartition(3)


def odd(d):
    unit = [0.25] * d
    return [(500, unit, 1), (500, unit, 1), (500, unit, 2), (None, unit, 1), (501, None, 1), (502, unit, None), (503, [NAN] * d, 1), (504, [INF] * d, 1), (505, [None] * d, 1), (550, [0.5] * (d - 1), 1), (551, [0.5] * (d - 1), 1), (552, [0.3] * (d - 1), 0), (600, [0.0] * d, 3), (601, [-0.5] * d, 3), (650, [], 1)]


def mined(rows, every=50):
    """Every score, in plain Python."""
    kept = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if v and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    late = lambda i: (i is None, i or 0)
    for k, (i, v, y) in enumerate(kept):
        if i is None or i % every:
            continue
        scores = [(sum(a * b for a, b in zip(v, w, strict=True)), j, z) for m, (j, w, z) in enumerate(kept) if m != k and len(w) == len(v)]
        for s, j, _ in sorted((x for x in scores if x[2] == y), key=lambda x: (-x[0], late(x[1])))[:5]:
            fit = sorted((x for x in scores if x[2] != y and 50 * s <= 100 * x[0] <= 95 * s), key=lambda x: (-x[0], late(x[1])))[:3]
            out.update((i, j, r, n, s, t) for r, (t, n, _) in enumerate(fit, 1))
    return out


@pytest.mark.parametrize("d", [7, 16])
def test_hard_negatives(spark, d):
    rows = vectors(400, d, d) + odd(d)
    got = hard_negatives.hard_negatives(frame(spark, rows), block=64, sample=100).collect()
    assert Counter((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got) == mined(rows)
    assert len(got) > 50


def test_hard_negatives_empty(spark):
    assert hard_negatives.hard_negatives(frame(spark, [])).count() == 0
    assert hard_negatives.hard_negatives(frame(spark, [(50, [1.0], 1)])).count() == 0


def test_bounds_are_rigorous_and_leave_few():
    rng = np.random.default_rng(5)
    x = hard_negatives.whole(rng.normal(0, 0.125, (5000, 64)), 256)
    words = hard_negatives.train(list(x[:1000]))
    codes, missed, step = hard_negatives.encode(x, words)
    low, high = hard_negatives.bounds(codes, missed, step, words, x[:40])
    exact = x @ x[:40].T
    assert (low <= exact).all() and (exact <= high).all()
    best = np.sort(exact, axis=0)[-5]
    assert (high >= best).mean() < 0.1  # of all rows, those that have to be recomputed for the best five


def lloyd(rows, d, clusters=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(x)) for x in v], v) for i, v, *_ in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[2]))
    c = [r[1] for r in order[:clusters]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v, _ in kept:
            groups[nearest(v)[1]].append(v)
        c = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if groups[j] else m for j, m in enumerate(c)]
    found = [(i, *nearest(v)) for i, v, _ in kept]
    inertia = Counter()
    for _, s, j in found:
        inertia[j] += s
    return Counter((i, j, s, inertia[j], sum(inertia.values()), ball_kmeans.centroid_digest(c[j])) for i, s, j in found)


@pytest.mark.parametrize("block", [7, 1000])
def test_ball_kmeans(spark, block):
    rows = vectors(300, 12, 3, 9) + odd(12)
    got = ball_kmeans.ball_kmeans(frame(spark, rows), 12, block=block).collect()
    assert Counter((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], ball_kmeans.centroid_digest(r["centroid"])) for r in got) == lloyd(rows, 12)


def test_ball_kmeans_small(spark):
    assert ball_kmeans.ball_kmeans(frame(spark, []), 12).count() == 0
    few = [(k, [float(k)] * 12, 0) for k in range(3)] + [(9, [1e30] * 12, 0)]
    got = ball_kmeans.ball_kmeans(frame(spark, few), 12).collect()
    assert len(got) == 4 and all(r["distance"] == 0 for r in got)


def test_balls_compare_few():
    """Separate balls: a round computes little more than one distance a vector, and nothing where no centroid moved."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-10000, 10000, (8, 64))
    cluster = rng.integers(0, 8, 4000)
    x = centres[cluster] + rng.integers(-50, 50, (4000, 64))
    distance = np.zeros(4000, np.int64)
    now = cluster.copy()
    assert ball_kmeans.reassign(x, now, distance, centres, np.ones(8, bool)) == 4000 and (now == cluster).all()
    assert ball_kmeans.reassign(x, now, distance, centres, np.zeros(8, bool)) == 0
    now[:] = 0
    ball_kmeans.reassign(x, now, distance, centres, np.ones(8, bool))
    every = ((x[:, None, :] - centres[None]) ** 2).sum(2)
    assert (now == every.argmin(1)).all() and (distance == every.min(1)).all()


def test_rounds_do_not_shuffle_vectors(spark, monkeypatch):
    """The tables of the rounds lie in the same buckets as the vectors."""
    plans = []
    real = ball_kmeans.materialize

    def seen(df, what, *more):
        if what == "assigned":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, what, *more)

    monkeypatch.setattr(ball_kmeans, "materialize", seen)
    ball_kmeans.ball_kmeans(frame(spark, vectors(60, 12)), 12, block=5)
    assert len(plans) > 1 and not any("Exchange" in p for p in plans)


def cheapest(places, penalty, length):
    f = [0] + [math.inf] * (len(places) - 1)
    for j in range(1, len(places)):
        for i in range(j):
            n = int(places[j] - places[i])
            if n <= length:
                f[j] = min(f[j], f[i] + (0 if n & (n - 1) == 0 else length - n) + int(penalty[j]))
    return f[-1]


@pytest.mark.parametrize("seed", range(30))
def test_windows(seed):
    rng = np.random.default_rng(seed)
    length = int(rng.choice([8, 16, 64]))
    places = np.concatenate([[0], np.cumsum(rng.integers(1, length // 2 + 1, 60))])
    penalty = rng.choice([0, 1, 5], 61)
    penalty[0] = 0
    chosen, cost = window_packing.windows(places, penalty, length)
    assert chosen[0] == 0 and chosen[-1] == 60 and all(places[b] - places[a] <= length for a, b in zip(chosen, chosen[1:], strict=False))
    paid = sum(int(penalty[b]) + (0 if (n := int(places[b] - places[a])) & (n - 1) == 0 else length - n) for a, b in zip(chosen, chosen[1:], strict=False))
    assert paid == cost == cheapest(places, penalty, length)


LONG = " ".join(f"Word{i % 977} x{i % 89}." if i % 9 == 0 else f"w{i % 977} x{i % 89}" for i in range(9000))


@pytest.mark.parametrize("stretch", [3000, 1 << 19])
def test_window_packing(spark, stretch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(window_packing.default_tokenizer())
    texts = [None, "", "One. Two. Three.", "same", "same", LONG, "x" * 20000, "\n\n\n", "été. 漢字。漢字。", "a<|endoftext|>b"]
    rows = [(k if k != 2 else None, t) for k, t in enumerate(texts)] + [(3, "again. " * 40)] + [(100 + k, f"Number {k} is here. " * (k % 50)) for k in range(200)]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], DOCS).repartition(3)
    ids = Counter((i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in rows)
    got = window_packing.pack(docs, stretch=stretch).collect()
    whole, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        x = np.frombuffer(r["ids"], "<u4")
        assert len(x) == r["length"] > 0 and zlib.crc32(r["ids"]) == r["ids_crc32"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["doc_id"]))
        whole[r["doc_id"]].append((r["start"], tuple(x.tolist()), r["doc_tokens"]))
    for s in sequences.values():
        s.sort()
        assert [o for o, *_ in s] == [sum(x[1] for x in s[:k]) for k in range(len(s))] and sum(x[1] for x in s) <= 2048
        assert [x[2] is not None for x in s] == sorted(x[2] is not None for x in s) and (known := [x[2] for x in s if x[2] is not None]) == sorted(known)  # the order of documents
    left = Counter(ids)
    for i, parts in whole.items():
        if sum(n for (j, _), n in ids.items() if j == i) == 1:
            x = sum((p for _, p, _ in sorted(parts)), ())
            assert [s for s, *_ in sorted(parts)] == [sum(len(p) for _, p, _ in sorted(parts)[:k]) for k in range(len(parts))]
            assert all(n == len(x) for *_, n in parts)
            left[i, x] -= 1
    assert sorted({i for (i, _), n in left.items() if n}) == [3]  # the doc_id of two rows
    assert sum(r["length"] for r in got) == sum(len(x) * n for (_, x), n in ids.items())
    tokens = sum(r["length"] for r in got)
    padding = sum(0 if (n := sum(x[1] for x in s)) & (n - 1) == 0 else 2048 - n for s in sequences.values())
    assert padding < 0.02 * tokens


def test_window_packing_cuts_at_sentences():
    """A text of sentences is cut at their ends, nearly without padding."""
    tables = window_packing.sentence_tables(window_packing.default_tokenizer())
    from voxelflow.llm.packing import _encoder

    text = " ".join(f"This is sentence number {k} of a long text, {'and it goes on ' * (k % 5)}until here." for k in range(2000))
    ids = np.frombuffer(next(_encoder(window_packing.default_tokenizer()).encode([text])), "<u4")
    pieces = window_packing.stretch_pieces([(1, ids)], tables)
    ends = [np.frombuffer(p[-1], "<u4")[-1] for p in pieces]
    assert all(tables[0][k] for k in ends)
    sizes = Counter()
    for p in pieces:
        sizes[p[5]] += p[2]
    assert sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes.values()) < 0.01 * len(ids)


def test_window_packing_empty(spark):
    assert window_packing.pack(spark.createDataFrame([], DOCS)).count() == 0

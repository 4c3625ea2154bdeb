"""The pipeline's near-dedup stage against all pairs of exact Jaccard similarities."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from voxelflow.llm import neardup
from voxelflow.llm.common import row_key

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
dedup = dict(corpus_pipeline.STAGES)["near-dedup"]


def edited(rng, words, n):
    out = list(words)
    for i in rng.choice(len(out), n, replace=False):
        out[i] = f"e{rng.integers(1 << 40)}"
    return out


def texts():
    """Unlike texts, and copies with so many words changed that similarities lie around 0.8."""
    rng, found = np.random.default_rng(3), []
    for _ in range(40):
        base = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(60, 400))]
        found += [base, *(edited(rng, base, int(len(base) * share)) for share in (0.005, 0.012, 0.018, 0.022, 0.026, 0.05))]
    crowd = [f"c{x}" for x in rng.integers(0, 5000, 200)]
    found += [edited(rng, crowd, int(rng.integers(1, 5))) for _ in range(150)]
    return [" ".join(x) for x in found]


def groups(given):
    """The group number of each text by all pairs."""
    sets = []
    for text in given:
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    near = 0
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                near += 1
                up[root(i)] = root(j)
    return [root(i) for i in range(len(sets))], near


def test_kept_set(spark):
    given = texts()
    group, near = groups(given)
    assert near > 500 and 40 < len(set(group)) < len(given) - 200
    kept = [r.doc_id for r in dedup(spark, spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(given)], DOCS), "").collect()]
    assert sorted(kept) == sorted({g: i for i, g in reversed(list(enumerate(group)))}.values())


def test_simhash_finds_candidates(spark):
    """Without any MinHash entry the covering tables connect just what near pairs within the radius connect."""
    given = list(dict.fromkeys(texts()))
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(given)], DOCS)
    sets = [neardup.shingles(t.encode()) for t in given]
    prints = [neardup.simhash.majority(s) & (1 << 64) - 1 for s in sets]
    rows = {r.doc_id: r.row for r in docs.select("doc_id", row_key(docs).alias("row")).collect()}
    alone = spark.createDataFrame([(i, rows[i], len(s), f - (f >> 63 << 64)) for i, (s, f) in enumerate(zip(sets, prints, strict=True))], "id long, row long, size long, fp long")
    got = {(min(r.u, r.v), max(r.u, r.v)) for r in neardup._links(docs, alone.withColumn("keys", F.array().cast("array<long>"))).collect()}
    up = list(range(len(given)))

    def root(i):
        return i if up[i] == i else root(up[i])

    for u, v in got:
        up[root(u)] = root(v)
    within = 0
    for i in range(len(given)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            near = 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both)
            if near and (prints[i] ^ prints[j]).bit_count() <= neardup.simhash.RADIUS:
                within += 1
                assert root(i) == root(j)
    assert within > 50
    group, _ = groups(given)  # nothing that is not near is connected
    assert all(group[u] == group[v] for u, v in got)


def test_odd_rows(spark):
    """Null and repeated ids, equal rows, blank texts: one row of each group stays, nulls last."""
    long = " ".join(f"l{i}" for i in range(80))
    rows = [
        (None, "clean text without an id at all here", "en", "a", 1), (None, "another clean text that has no id either", "en", "a", 2),
        (1, long, "en", "a", 3), (1, long, "en", "a", 3), (1, long + " more", "en", "b", 4), (None, long, "en", "a", 5),
        (2, "this id comes twice with unlike texts first", "en", "a", 6), (2, "and the second text of it is another", "en", "a", 7),
        (0, long + " l", "en", "c", 8), (3, "", "en", "a", 9), (4, None, None, None, None), (None, " \n", "en", "a", 10),
        (None, "equal rows without an id", "en", "a", 11), (None, "equal rows without an id", "en", "a", 11),
    ]
    group, _ = groups([r[1] for r in rows])
    got = list(map(tuple, dedup(spark, spark.createDataFrame(rows, DOCS), "").collect()))
    best = {}
    for g, r in zip(group, rows, strict=True):
        best.setdefault(g, []).append(r)
    assert len(got) == len(best)
    for members in best.values():
        (kept,) = [r for r in got if r in members]
        assert (kept[0] is None, kept[0] or 0) == min((r[0] is None, r[0] or 0) for r in members)
    assert dedup(spark, spark.createDataFrame([], DOCS), "").count() == 0


def test_clashing_columns(spark):
    """Columns that have the names of helper columns stay as they are, in near-dedup and mixing."""
    stages = dict(corpus_pipeline.STAGES)
    names = ["_key", "_row", "_id", "_n", "_copies", "_copy", "__key", "row", "component"]
    rows = [(k, f"one two three four five six {k} seven", "en", "ab"[k % 2], 1, *[10 * k + i for i in range(len(names))]) for k in range(6)]
    rows += [(9, rows[0][1], "en", "a", 1, *[7] * len(names)), rows[1]]
    docs = spark.createDataFrame(rows, DOCS + "".join(f", {c} long" for c in names))
    got = stages["near-dedup"](spark, docs, "")
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == sorted(rows[:6])
    mixed = stages["mixing"](spark, docs, "")
    assert mixed.columns == docs.columns and set(map(tuple, mixed.collect())) <= set(rows) and mixed.count() > 0

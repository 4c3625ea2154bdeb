"""Near-duplicates by exact Jaccard similarity of word shingles, found through SimHash and MinHash tables.

A text is the set of its shingles of SHINGLE words. Two texts are near where the sets' Jaccard
similarity is SIMILARITY or more. Candidates come first from the covering tables of op1's SimHash,
over the fingerprint of the set: all texts within simhash.RADIUS bits of each other meet there. Near texts
may differ in more bits (15 % of them just at 0.8, and a radius that covers it leaves too few kept bits
in a covering mask to tell texts apart), so the rest comes from TABLES MinHash tables, each keyed by
ROWS minima of seeded permutations of the shingle hashes: a pair just at 0.8 meets in some table but for
(1 - 0.8^6)^40 = 5e-6 of such pairs, nearer pairs more surely, unlike texts hardly ever. Candidates
of both are then compared exactly, shingle by shingle.

Texts of one shingle set are one node, so copies never make pairs. Texts within the SimHash radius, and
texts that meet in a crowded MinHash entry (more than CROWD texts), form regions: the components of
"is within the radius or shares a crowded entry". A region is
cut into blocks of about BLOCK texts, and a task compares all texts of two blocks at once: their
shingle sets become counts of common shingles, by a matrix product for shingles that many of the texts
hold and pair by pair for rare ones. Only one edge for each text leaves a task, to the least text it is
connected with there, so no pairs are written or shipped, however large a group is; comparing
costs time with the square of a region. Pairs of sparse entries that no region holds
are shipped, CROWD for each text and table at most, with their shingle hashes.

Defined cases: null and blank texts have no shingles and are copies of each other; a text of fewer
than SHINGLE words is one shingle; ASCII case and white space don't count. Rows with a null or
repeated doc_id are rows like others.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import _other, components, free_names, materialize, row_key

SHINGLE = 5
#: Least similarity, as a fraction.
SIMILARITY = (4, 5)
ROWS, TABLES = 6, 40
CROWD, BLOCK = 4, 1024
#: Shingles that at least so many texts of a task hold are counted by a matrix product.
COMMON = 48
_CHUNK = 512
_digest = partial(xxhash.xxh64_intdigest, seed=5)
_TURN = np.random.default_rng(11).integers(0, 1 << 63, (ROWS * TABLES, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: bytes | None) -> np.ndarray:
    """The sorted hashes of the distinct shingles of a UTF-8 text."""
    words = (data or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    grams = zip(*(words[i:] for i in range(SHINGLE)), strict=False) if len(words) > SHINGLE else iter([words])
    return np.unique(np.fromiter(map(_digest, map(b" ".join, grams)), np.uint64, max(1, len(words) - SHINGLE + 1)))


def table_keys(found: np.ndarray) -> np.ndarray:
    """One key for each table."""
    least = np.full(ROWS * TABLES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), _CHUNK):
        np.minimum(least, (_TURN * found[i : i + _CHUNK]).min(1), out=least)
    keys = np.arange(1, TABLES + 1, dtype=np.uint64)
    for row in least.reshape(ROWS, TABLES):
        keys = (keys ^ row) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def _signatures(texts: pa.Array) -> pa.Array:
    sets = [shingles(x.as_py()) for x in texts]
    ids = pa.array([xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) if len(s) else 0 for s in sets], pa.int64())
    keys = pa.array([table_keys(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))
    prints = pa.array([simhash.majority(s) if len(s) else 0 for s in sets], pa.int64())
    return pa.StructArray.from_arrays([ids, pa.array(map(len, sets), pa.int64()), prints, keys], names=["id", "size", "fp", "keys"])


def near(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of a and b shingles with so many in common are near."""
    return common * (SIMILARITY[0] + SIMILARITY[1]) >= (a + b) * SIMILARITY[0]


def _shingled(texts: pa.Array) -> pa.Array:
    return pa.array([shingles(x.as_py()).tobytes() for x in texts], pa.binary())


def _compared(left: pa.Array, right: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(left, right, strict=True):
        a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
        out.append(bool(near(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b))))
    return pa.array(out, pa.bool_())


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """[left, right] numbers of common shingles of the sets at these places."""
    lengths = np.array([len(x) for x in sets])
    held, of, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    text = np.repeat(np.arange(len(sets)), lengths)
    row, column = np.full(len(sets), -1), np.full(len(sets), -1)
    row[left], column[right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros((len(left), len(right)), np.float32)
    # common shingles: presence matrices, some columns at a time
    dense = np.flatnonzero(times >= COMMON)
    place = np.full(len(held), -1)
    place[dense] = np.arange(len(dense))
    at = place[of]
    for start in range(0, len(dense), 4096):
        here = np.flatnonzero((at >= start) & (at < start + 4096))
        present = np.zeros((len(sets), min(4096, len(dense) - start)), np.float32)
        present[text[here], at[here] - start] = 1
        out += present[left] @ present[right].T
    # rare ones: the pairs of texts that hold each
    rare = np.flatnonzero((times > 1) & (times < COMMON))
    if len(rare):
        order = np.argsort(of, kind="stable")
        begins = np.concatenate([[0], np.cumsum(times)])
        for n in np.unique(times[rare]).tolist():
            members = text[order[begins[rare[times[rare] == n]][:, None] + np.arange(n)]]  # [shingle, holder]
            for k in range(0, len(members), 1 + (1 << 20) // (n * n)):
                some = members[k : k + 1 + (1 << 20) // (n * n)]
                i, j = row[some][:, :, None], column[some][:, None, :]
                hit = (i >= 0) & (j >= 0)
                code = (i * len(right) + j)[hit]
                out += np.bincount(code, minlength=out.size).reshape(out.shape)
    return out


def least_linked(linked: np.ndarray) -> np.ndarray:
    """For each node the least node connected with it. linked: a symmetric matrix."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(1, initial=len(linked)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _block_links(batches):
    """Edges (u, v) of runs of texts (run, id, left, right, shingles): a run holds one block or two."""

    def edges(rows: list[dict]) -> pa.RecordBatch | None:
        sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
        left, right = (np.flatnonzero([r[side] for r in rows]) for side in ("left", "right"))
        if not len(left) or not len(right):
            return None
        size = np.array([len(x) for x in sets])
        hit = near(common_counts(sets, left, right), size[left][:, None], size[right][None, :])
        linked = np.zeros((len(rows), len(rows)), bool)
        linked[np.ix_(left, right)] = hit
        linked |= linked.T
        least = least_linked(linked)
        at = np.flatnonzero(least != np.arange(len(rows)))
        ids = np.array([r["id"] for r in rows])
        return pa.RecordBatch.from_arrays([pa.array(ids[least[at]]), pa.array(ids[at])], names=["u", "v"]) if len(at) else None

    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["run"] != held[0]["run"]:
                if (found := edges(held)) is not None:
                    yield found
                held = []
            held.append(row)
    if held and (found := edges(held)) is not None:
        yield found


def _named(nodes: DataFrame, group: DataFrame | None, node: str, out: str) -> DataFrame:
    """``nodes`` with the component of column ``node`` as ``out``."""
    if group is None:
        return nodes.withColumn(out, F.col(node))
    found = group.select(_other("node").alias("_n"), F.col("component").alias("_c"))
    return nodes.withColumn("_n", _other(node)).join(found, "_n", "left").withColumn(out, F.coalesce("_c", node)).drop("_n", "_c")


def _within_radius(sets: DataFrame) -> DataFrame:
    """Links (u, v) between sets within the SimHash radius; any two within it are connected."""
    some = sets.where("size > 0").select("id", "fp")
    prints = materialize(some.groupBy("fp").agg(F.min("id").alias("leader"), F.count("*").alias("n")), "prints")
    same = some.select("id", _other("fp").alias("k")).join(prints.where("n > 1").select(_other("fp").alias("k"), "leader"), "k")
    first, second = (prints.select(F.col("fp").alias(c), F.col("leader").alias(f"_{c}")) for c in "uv")
    other = simhash.fingerprint_links(prints.select("fp")).join(first, "u").join(second, "v").select("_u", "_v")
    return same.where("id <> leader").select("id", "leader").union(other).toDF("u", "v")


def _links(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) between the distinct shingle sets, which connect just what near pairs connect."""
    tables = sets.select("id", "size", F.explode("keys").alias("t"))
    shared = tables.groupBy("t").agg(F.count("*").alias("n"), F.min("id").alias("leader")).where("n > 1")
    members = tables.select("id", "size", _other("t").alias("t")).join(shared.select(_other("t").alias("t"), "n", "leader"), "t")
    members = materialize(members, "members")
    crowded = members.where((F.col("n") > CROWD) & (F.col("id") != F.col("leader"))).select(F.col("id").alias("u"), F.col("leader").alias("v")).distinct()
    region = materialize(components(crowded.union(_within_radius(sets))), "regions")

    wanted = members.select("id").union(region.select("node")).distinct().join(sets.select("id", "row"), "id")
    texts = docs.select(row_key(docs).alias("row"), F.col("text").cast("binary").alias("text")).join(wanted, "row")
    texts = texts.groupBy("id").agg(F.first("text").alias("text")).select("id", F.arrow_udf(_shingled, "binary")("text").alias("shingles"))
    texts = materialize(texts, "texts")

    sizes = region.groupBy("component").agg(F.count("*").alias("m"))
    placed = region.withColumn("k", _other("component")).join(sizes.select(_other("component").alias("k"), "m"), "k")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    placed = placed.select("node", "component", blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("run", F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")))
    placed = placed.select(_other("node").alias("k"), "run", (F.col("block") <= F.col("other")).alias("left"), (F.col("block") >= F.col("other")).alias("right"))
    dealt = placed.join(texts.select(_other("id").alias("k"), "id", "shingles"), "k").drop("k").repartition("run").sortWithinPartitions("run")
    inside = materialize(dealt.mapInArrow(_block_links, "u long, v long"), "inside")

    sparse = _named(members.where(F.col("n") <= CROWD).select("t", "id", "size"), region, "id", "c")
    other = sparse.select(_other("t").alias("t"), F.col("id").alias("v"), F.col("size").alias("m"), F.col("c").alias("d"))
    fits = F.least("size", "m") * SIMILARITY[1] >= F.greatest("size", "m") * SIMILARITY[0]
    pairs = sparse.select(_other("t").alias("t"), "id", "size", "c").join(other, "t").where("id < v and c <> d").where(fits).select(F.col("id").alias("u"), "v").distinct()
    first = pairs.select("v", _other("u").alias("k")).join(texts.select(_other("id").alias("k"), F.col("shingles").alias("a")), "k")
    both = first.select(_other("k").alias("u"), "a", _other("v").alias("k")).join(texts.select(_other("id").alias("k"), F.col("shingles").alias("b")), "k")
    return inside.union(both.where(F.arrow_udf(_compared, "boolean")("a", "b")).select("u", _other("k").alias("v")))


def groups(docs: DataFrame) -> DataFrame:
    """row (hash), doc_id, component of each row; rows of one component are near-duplicates."""
    signature = F.arrow_udf(_signatures, "struct<id: long, size: long, fp: long, keys: array<long>>")(F.col("text").cast("binary"))
    rows = materialize(docs.select(row_key(docs).alias("row"), "doc_id", signature.alias("s")).select("row", "doc_id", "s.*"), "signatures")
    sets = rows.groupBy("id").agg(F.min("row").alias("row"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    group = components(_links(docs, materialize(sets, "sets")))
    return _named(rows.select("row", "doc_id", "id"), group, "id", "component").select("row", "doc_id", "component")


def keep_one(docs: DataFrame) -> DataFrame:
    """Exactly one row of each group of near-duplicates, with its own columns: the smallest doc_id,
    nulls last, then the smallest row hash. Of fully equal rows one stays."""
    rows = groups(docs).groupBy("row", "doc_id", "component").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row", "n")).alias("w")
    key, row, id, n = free_names(docs, "_key", "_row", "_id", "_n")
    kept = materialize(rows.groupBy("component").agg(first).select("w.*"), "kept").select(F.col("row").alias(row), F.col("doc_id").alias(id), F.col("n").alias(n))
    keyed = docs.withColumn(key, row_key(docs))

    def of(rows: DataFrame) -> DataFrame:
        return keyed.join(rows, F.col(key).eqNullSafe(F.col(row)) & F.col("doc_id").eqNullSafe(F.col(id)), "left_semi").select(docs.columns)

    return of(kept.where(F.col(n) == 1)).union(of(kept.where(F.col(n) > 1)).dropDuplicates())

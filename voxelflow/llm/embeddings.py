"""Embedding near-duplicates by randomised-rotation binary codes with correction factors.

Unit vectors are turned by seeded random rotations. A vector's code is the signs of its turned
components, one bit each, its correction factor the inner product of code and turned vector; both are
computed and stored once. Beside them lies the turned vector in PLANES bits a component, rounded at
random so that it is right at the mean. For another vector y, <code, turned y> / factor, taken by
counting common bits of code and y's bit planes, estimates the inner product without bias, and its
error is bounded with high probability by BOUND standard deviations of both roundings. Pairs whose
bound reaches below the threshold are cast aside; for the others, and only for them, the vectors are
fetched and the cosine is computed in double precision.

Candidates come from tables of sign bits: two vectors meet where they agree in all bits of a
table. Bits per table grow with the logarithm of the rows, and there are as many tables as a pair
just at the threshold needs to meet in one with probability RECALL; pairs nearer than that meet
more surely. Equal vectors are one candidate with a multiplicity, so copies never make pairs.

Dense regions are taken by balls first. In a bucket of more than CROWD vectors one of them leads;
vectors within half the threshold's angle of their leader, by their exact cosine, form a ball, and all
of a ball are linked with each other for certain. A ball counts its links by its size and is
joined by one edge a member. Vectors without a ball whose buckets are still crowded get new
leaders, LEADER_ROUNDS times at most. Buckets that hold one ball alone are done; in the others pairs
of different balls are looked at. A bucket larger than BLOCK is split and compared block by block. So
time grows with the square of a region only where it is too wide for a ball and all its pairs are to be
counted.

Defined cases: null vectors, zero vectors and those with null or non-finite components link with
nothing; vectors of different lengths don't link; a null vec_id keeps its row, counts as linked by
others and has a null component unless a named vector reaches it; repeated rows are separate
vectors; columns beside vec_id and embedding are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _other, components, materialize, table

THRESHOLD = 0.9
RECALL = 0.998
BLOCK, CROWD, LEADER_ROUNDS = 1024, 96, 4
BOUND = 4.0
PLANES = 4
_CHUNK = 1 << 15
_SEED = 7
_rotations: dict = {}


def rotation(d: int, k: int) -> np.ndarray:
    """The k-th random rotation of dimension d."""
    if (d, k) not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng((_SEED, d, k)).standard_normal((d, d)))
        _rotations[d, k] = q * np.sign(np.diag(r))
    return _rotations[d, k]


def table_sizes(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a table and number of tables for n vectors."""
    bits = max(6, math.ceil(math.log2(max(2, n))) - 4)
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def rotations_for(bits: int, tables: int, d: int) -> int:
    """How many rotations give each bit of each table a sign of its own."""
    return -(-bits * tables // d)


def table_keys(turned: list[np.ndarray], bits: int, tables: int) -> np.ndarray:
    """[vector, table] keys. Bits are drawn by seed from the signs in all rotations, each sign once
    at most, so tables are as independent as rotations: see ``rotations_for``."""
    signs = np.hstack(turned) > 0
    drawn = np.random.default_rng((_SEED, signs.shape[1], bits)).permutation(signs.shape[1])[: bits * tables].reshape(tables, bits)
    weight = 1 << np.arange(bits, dtype=np.int64)
    return np.stack([signs[:, of] @ weight for of in drawn], 1)


def _units(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _words(bits: np.ndarray) -> np.ndarray:
    """Boolean rows as 64-bit words."""
    packed = np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8")


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors: code words, bit planes of the turned vectors [row, plane, word], and
    (factor, least component, step, sum of components) as they are read back from the planes."""
    n, d = unit.shape
    turned = unit @ rotation(d, 0).T
    low = turned.min(1)
    step = np.maximum(turned.max(1) - low, 1e-12) / (2**PLANES - 1)
    level = np.floor((turned - low[:, None]) / step[:, None] + np.random.default_rng((_SEED, d)).random((n, d))).clip(0, 2**PLANES - 1).astype(np.uint8)
    planes = np.stack([_words(level >> k & 1 == 1) for k in range(PLANES)], 1)
    factor = np.abs(turned).sum(1) / math.sqrt(d)
    return _words(turned > 0), planes, np.stack([factor, low, step, low * d + step * level.sum(1)], 1)


def estimates(code: np.ndarray, factor: np.ndarray, planes: np.ndarray, numbers: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of pairs (code, factor of one side; planes, numbers of the other) and
    how far off they are with high probability at most."""
    common = np.bitwise_count(code[:, None, :] & planes).sum(2, dtype=np.int64) @ (1 << np.arange(PLANES))
    set_ = np.bitwise_count(code).sum(1, dtype=np.int64)
    plus = numbers[:, 1] * set_ + numbers[:, 2] * common  # components where the code is positive
    guess = (2 * plus - numbers[:, 3]) / math.sqrt(d) / factor
    error = np.maximum(0, 1 - factor**2) / factor**2 / max(1, d - 1) + (numbers[:, 2] / factor) ** 2 / 4
    return guess, BOUND * np.sqrt(error)


STORED = "rep long, n long, d int, code binary, planes binary, numbers binary, keys array<long>"


def _store(bits: int, tables: int):
    def of(batches):
        for batch in batches:
            rep, n, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            lengths = np.diff(vectors.offsets.to_numpy())
            for d in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == d)
                unit = _units(vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
                keys = table_keys([unit @ rotation(d, k).T > 0 for k in range(rotations_for(bits, tables, d))], bits, tables) * tables + np.arange(tables)
                blobs = [pa.array([x.tobytes() for x in a], pa.binary()) for a in codes(unit)]
                ends = pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32))
                columns = [pa.array(rep[rows]), pa.array(n[rows]), pa.array(np.full(len(rows), d, np.int32)), *blobs, pa.ListArray.from_arrays(ends, pa.array(keys.reshape(-1)))]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in STORED.split(", ")])

    return of


def _runs(batches) -> Iterator[pa.Table]:
    """Tables of whole runs of the column ``run``, which is sorted, of about _CHUNK rows."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        run = batch.column("run").to_numpy()
        if rows >= _CHUNK or rows + batch.num_rows > 4 * _CHUNK:
            last = held[-1].column("run")[-1].as_py()
            new = np.flatnonzero(run != last)
            if len(new):
                held.append(batch.slice(0, int(new[0])))
                yield pa.Table.from_batches(held)
                held, rows = [], 0
                batch = batch.slice(int(new[0]))
        held.append(batch)
        rows += batch.num_rows
    if rows:
        yield pa.Table.from_batches(held)


def run_pairs(run: np.ndarray, left: np.ndarray, right: np.ndarray, ball: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (left row, right row) within runs of equal ``run``, of different balls; where both rows
    are on both sides, each pair once. Runs of one size go together, ``most`` pairs at a time at most."""
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    sizes = np.diff(np.r_[starts, len(run)])
    for size in np.unique(sizes[sizes > 1]).tolist():
        of_size = starts[sizes == size]
        a, b = np.triu_indices(size, 1)
        for k in range(0, len(a), most):
            x, y = a[k : k + most], b[k : k + most]
            together = max(1, most // len(x))
            for s in range(0, len(of_size), together):
                base = of_size[s : s + together, None]
                i, j = (base + x).reshape(-1), (base + y).reshape(-1)
                i, j = np.where(left[i] & right[j], i, j), np.where(left[i] & right[j], j, i)
                keep = left[i] & right[j] & (ball[i] != ball[j])
                yield i[keep], j[keep]


def _candidates(threshold: float):
    """Pairs (u, v), u < v, that the bounds leave open."""

    def of(batches):
        for rows in _runs(batches):
            d_of = rows.column("d").to_numpy()
            for d in np.unique(d_of).tolist():
                part = rows.take(pa.array(np.flatnonzero(d_of == d))).combine_chunks()
                blob = lambda c, kind: np.frombuffer(b"".join(part.column(c).to_pylist()), kind).reshape(part.num_rows, -1)  # noqa: B023, E731
                rep, ball, run = (part.column(c).to_numpy() for c in ("rep", "ball", "run"))
                left, right = (np.asarray(part.column(c).to_numpy(zero_copy_only=False), bool) for c in ("left", "right"))
                code, numbers = blob("code", "<u8"), blob("numbers", "<f8")
                planes = blob("planes", "<u8").reshape(len(rep), PLANES, -1)
                for i, j in run_pairs(run, left, right, ball):
                    guess, error = estimates(code[i], numbers[i, 0], planes[j], numbers[j], d)
                    open_ = guess + error >= threshold
                    a, b = rep[i[open_]], rep[j[open_]]
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["u", "v"])

    return of


def _cosines(left: pa.Array, right: pa.Array) -> pa.Array:
    """Cosines of pairs of vectors; of different lengths: null."""
    p, q = (np.diff(x.offsets.to_numpy()) for x in (left, right))
    out, known = np.zeros(len(p)), p == q
    for d in np.unique(p[known]).tolist():
        rows = np.flatnonzero(known & (p == d))
        x, y = (_units(v.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)) for v in (left, right))
        out[rows] = (x * y).sum(1)
    return pa.array(out, mask=~known)


def _with_cosine(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs (u, v) with their vectors' cosine."""
    a = pairs.withColumn("k", _other("u")).join(vectors.select(_other("rep").alias("k"), F.col("v").alias("_a")), "k").drop("k")
    both = a.withColumn("k", _other("v")).join(vectors.select(_other("rep").alias("k"), F.col("v").alias("_b")), "k").drop("k")
    return both.withColumn("cosine", F.arrow_udf(_cosines, "double")("_a", "_b")).drop("_a", "_b")


def _balls(tables: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """rep, ball of vectors in crowded buckets that lie near their leader; a ball is named by it."""
    half = math.sqrt((1 + threshold) / 2) + 1e-9
    rows, found = tables.select("bucket", "rep"), None
    for k in range(LEADER_ROUNDS):
        mark = F.lit(k * 0x5DEECE66D1234567 & (1 << 63) - 1)
        leader = F.min(F.col("rep").bitwiseXOR(mark)).bitwiseXOR(mark)
        crowded = rows.groupBy("bucket").agg(F.count("*").alias("m"), leader.alias("v")).where(F.col("m") > CROWD).select("bucket", "v")
        led = materialize(rows.withColumn("k", _other("bucket")).join(crowded.select(_other("bucket").alias("k"), "v"), "k").select("bucket", F.col("rep").alias("u"), "v"), "led")
        if led.isEmpty():
            break
        near = _with_cosine(led.select("u", "v").distinct(), vectors).where(F.col("cosine") >= half)
        new = near.groupBy("u").agg(F.min(F.col("v").bitwiseXOR(mark)).bitwiseXOR(mark).alias("ball")).select(F.col("u").alias("rep"), "ball")
        new = materialize(new, "balls")
        found = new if found is None else found.union(new)
        rows = led.select("bucket", F.col("u").alias("rep")).withColumn("k", _other("rep")).join(new.select(_other("rep").alias("k")), "k", "left_anti").drop("k")
    return found


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id of each row."""
    finite = "exists(embedding, x -> x is null or isnan(x) or abs(x) = double('Infinity'))"
    usable = F.expr(f"coalesce(size(embedding) > 0 and not {finite} and exists(embedding, x -> x <> 0), false)")
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    rows = vectors.select("vec_id", F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    rows = rows.select("vec_id", F.when(usable, F.col("embedding")).alias("v"))
    group = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    group = materialize(group.select("first", "n", "v", F.xxhash64("v").alias("rep")), "vectors")
    bits, tables = table_sizes(group.count(), threshold, recall)
    stored = materialize(group.select("rep", "n", "v").mapInArrow(_store(bits, tables), STORED), "codes")
    keyed = stored.select("rep", "d", "code", "planes", "numbers", F.explode("keys").alias("key")).withColumn("bucket", F.xxhash64("key", "d")).drop("key")

    balls = _balls(keyed, group, threshold)
    if balls is None:
        keyed = keyed.withColumn("ball", F.col("rep"))
    else:
        named = balls.select(_other("rep").alias("k"), "ball")
        keyed = keyed.withColumn("k", _other("rep")).join(named, "k", "left").drop("k").withColumn("ball", F.coalesce("ball", "rep"))
    mixed = keyed.groupBy("bucket").agg(F.count("*").alias("m"), F.min("ball").alias("lo"), F.max("ball").alias("hi")).where("lo <> hi").select(_other("bucket").alias("k"), "m")
    open_ = keyed.withColumn("k", _other("bucket")).join(mixed, "k").drop("k")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    open_ = open_.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int"))
    open_ = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("run", F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")))
    open_ = open_.select("run", "rep", "ball", "d", "code", "planes", "numbers", (F.col("block") <= F.col("other")).alias("left"), (F.col("block") >= F.col("other")).alias("right"))
    dealt = open_.repartition("run").sortWithinPartitions("run")
    pairs = dealt.mapInArrow(_candidates(threshold), "u long, v long").distinct()
    linked = materialize(_with_cosine(materialize(pairs, "pairs"), group).where(F.col("cosine") >= threshold).select("u", "v"), "links")

    size = group.select(_other("rep").alias("k"), "n")
    both = linked.union(linked.select("v", "u"))
    counts = both.withColumn("k", _other("v")).join(size, "k").groupBy("u").agg(F.sum("n").alias("links")).select(F.col("u").alias("rep"), "links")
    edges = linked
    if balls is not None:
        held = materialize(balls.withColumn("k", _other("rep")).join(size, "k").drop("k"), "held")
        whole = held.groupBy("ball").agg(F.sum("n").alias("total"), F.min("rep").alias("least"))
        held = held.withColumn("k", _other("ball")).join(whole.select(_other("ball").alias("k"), "total", "least"), "k")
        counts = counts.union(held.select("rep", (F.col("total") - F.col("n")).alias("links"))).groupBy("rep").agg(F.sum("links").alias("links"))
        edges = edges.union(held.select(F.col("rep").alias("u"), F.col("least").alias("v")))
    joined = components(edges)
    named = group.select("rep", "first", "n").join(counts, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    named = materialize(named.select("rep", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c")), "named")
    least = named.groupBy("c").agg(F.min("first").alias("component_id")).select(_other("c").alias("k"), "component_id")
    named = named.withColumn("k", _other("c")).join(least, "k").select("rep", "n_links", "component_id")
    rows = rows.select("vec_id", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("_rep"))
    out = rows.join(named, F.col("_rep") == F.col("rep"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("_rep").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))

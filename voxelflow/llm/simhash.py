"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint is the majority of its shingles' XXH64 bits. Every bit position has a code
of ``radius + 1`` bits; table v (one for each code but zero) drops the positions whose code is
orthogonal to v. Up to ``radius`` differing positions span less than the whole code space, so some
v is orthogonal to them all and drops them: each pair within the radius meets in some table, none is lost.

Links are between distinct fingerprints, so copies never make pairs. In a bucket of up to
``crowd`` fingerprints the links are tested one by one. The members of larger buckets are linked
through codes at half the radius: two fingerprints differ in at most ``radius`` bits just when some
code is within half of both. Its rows grow in proportion to the members, whatever their number.

The planner sizes a table before its rows are exploded, so it would send codes and buckets through the
driver; here joins are merge joins, and a code's members are found without any join.

Defined cases: null and empty texts have no shingles and the fingerprint 0; rows with a null
doc_id get the component of their fingerprint, null if no row of it has a doc_id; repeated rows
come out as often as they went in; columns beside doc_id and text are not read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _other, components, materialize, table

SHINGLE = 4
RADIUS = 4
CROWD = 48
_digest = partial(xxhash.xxh64_intdigest, seed=42)
_CHUNK = 1 << 16


def majority(hashes: np.ndarray) -> int:
    """The number, signed, whose bits are set in over half of the 64-bit hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(data: bytes | None, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a UTF-8 text, as a signed number."""
    words = (data or b"").lower().split()
    if not words:
        return 0
    grams = zip(*(words[i:] for i in range(size)), strict=False) if len(words) > size else iter([words])
    return majority(np.fromiter(map(_digest, map(b" ".join, grams)), "<u8", max(1, len(words) - size + 1)))


def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint(x.as_py()) for x in texts], pa.int64())


def simhash(text: str | Column = "text") -> Column:
    return F.arrow_udf(_fingerprints, "long")(F.col(text).cast("binary") if isinstance(text, str) else text.cast("binary"))


def covering_masks(radius: int = RADIUS) -> list[int]:
    """One mask of kept bit positions for each table, as signed numbers."""
    codes = 2 ** (radius + 1)
    masks = []
    for v in range(1, codes):
        kept = sum(1 << i for i in range(64) if ((i % (codes - 1) + 1) & v).bit_count() % 2)
        masks.append(kept - (1 << 64) if kept >> 63 else kept)
    return masks


def _near(radius: int) -> str:
    """SQL: the codes within radius // 2 (1 or 2) bits of fp, each once."""
    bit = "if({0} = 64, 0L, shiftleft(1L, {0}))"
    one = f"transform(sequence(0, 64), i -> fp ^ {bit.format('i')})"
    two = f"concat(array(fp), flatten(transform(sequence(0, 63), i -> transform(sequence(i + 1, 64), j -> fp ^ {bit.format('i')} ^ {bit.format('j')}))))"
    return {1: one, 2: two}[radius // 2]


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """Links (u, v) between the distinct fingerprints fp of ``prints``: each is within the radius,
    and any two within it are connected."""
    buckets = prints.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(covering_masks(radius))])).alias("b"))
    sizes = buckets.groupBy("b").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1")
    sizes = materialize(sizes, "buckets")
    near = F.expr("bit_count(u ^ v)") <= radius
    links = sizes.where("n = 2").where(near).select("u", "v")

    more = buckets.select("fp", _other("b").alias("k")).join(sizes.where("n > 2").select(_other("b").alias("k"), "n").hint("merge"), "k").select("k", "fp", "n")
    more = materialize(more, "crowded")
    few = more.where(F.col("n") <= crowd).groupBy("k").agg(F.collect_list("fp").alias("a"))
    pairs = few.select(F.explode(F.expr(f"flatten(transform(a, x -> transform(filter(a, y -> y > x and bit_count(x ^ y) <= {radius}), y -> struct(x as u, y as v))))")).alias("p"))
    # a number of partitions of its own: adaptive execution, too, sees only the few rows before the codes
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    codes = more.where(F.col("n") > crowd).select("fp").distinct().repartition(tasks, "fp").select("fp", F.explode(F.expr(_near(radius))).alias("c"))
    star = codes.select(F.min("fp").over(Window.partitionBy("c")).alias("u"), F.col("fp").alias("v")).where("u <> v")
    return links.union(pairs.select("p.u", "p.v")).union(star).distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links) of each row."""
    rows = materialize(docs.select("doc_id", simhash("text").alias("fp")), "fingerprints")
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "prints")
    group = components(fingerprint_links(prints, radius, crowd))
    named = prints.join(group.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "doc_id", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.select("fp", _other("component").alias("k")).join(least.select(_other("component").alias("k"), "component_id").hint("merge"), "k").select(_other("fp").alias("k"), "component_id")
    return rows.withColumn("k", _other("fp")).join(named.hint("merge"), "k").select("doc_id", "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

"""The latest cloud of each waypoint: keyed state, last write wins.

Rows: a key, an order (time, then a tie-breaker) and the payload. Batch and stream share one
rule, so replaying a stream gives what one batch gives.

The stream's state is a table in buckets of the key. A micro-batch reads and rewrites only the
buckets its keys fall into: each gets a new version, one file written by one task, so that a version
is there as a whole or not at all. Readers take each bucket's newest version; older ones than the last
few go. Merging is the same whatever was merged before, so a batch that runs again changes nothing, and
a version number is always above all that exist: a fresh checkpoint adds to a state, it
never overwrites one."""

from __future__ import annotations

import re
from collections import defaultdict
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; sums per key are partial, so a busy key is no hot spot."""
    payload = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*payload), F.struct(*order)).alias("_v")).select(*key, "_v.*")


def latest_group(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """All rows of each key that stand at its greatest order: the points of its latest cloud. A null
    key is a key of its own."""
    newest = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.max(F.struct(*order)).alias("_order"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key], F.struct(*order).eqNullSafe(F.col("_order")))
    return rows.join(newest, same).select(*rows.columns)


def fused(state: DataFrame, order: list[str], frame: str = "frame_id") -> DataFrame:
    """All cached rows under the frame of the most recent one."""
    return state.crossJoin(F.broadcast(state.agg(F.max_by(frame, F.struct(*order)).alias("fused_frame"))))  # one row


def _stored(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("version", T.LongType())])


def _versions(spark: SparkSession, path: str, schema: T.StructType) -> dict[int, dict[int, list[str]]]:
    """Files of each version of each bucket below ``path``: a few for each bucket, whatever they hold."""
    try:
        files = spark.read.schema(_stored(schema)).option("basePath", path).parquet(path).inputFiles()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        files = []
    found: dict[int, dict[int, list[str]]] = defaultdict(lambda: defaultdict(list))
    for file in files:
        if m := re.search(r"/bucket=(\d+)/version=(\d+)/[^/]+$", file):
            found[int(m[1])][int(m[2])].append(file)
    return found


def _read(spark: SparkSession, path: str, schema: T.StructType, files: list[str]) -> DataFrame:
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(_stored(schema)).option("basePath", path).parquet(*files).select(*schema.names)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def upsert(rows: DataFrame, key: list[str], order: list[str], path: str, buckets: int = 64, keep: int = 2, whole: bool = False) -> int | None:
    """Merges rows into the state below ``path`` and returns the new version (None: no rows). ``whole``:
    a key's payload is all rows of its greatest order, not one row."""
    spark, schema = rows.sparkSession, rows.schema
    placed = rows.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")).persist()
    try:
        touched = sorted(r[0] for r in placed.select("bucket").distinct().collect())  # not more than ``buckets``
        if not touched:
            return None
        held = _versions(spark, path, schema)
        version = 1 + max((v for versions in held.values() for v in versions), default=-1)
        files = [f for b in touched if b in held for f in held[b][max(held[b])]]
        both = _read(spark, path, schema, files).unionByName(placed.select(*schema.names))
        merged = (latest_group if whole else latest)(both, key, order).select(*schema.names).distinct()
        merged = merged.withColumns({"bucket": F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"), "version": F.lit(version).cast("long")})
        merged.repartition(len(touched), "bucket").write.partitionBy("bucket", "version").mode("append").parquet(path)
        for b in touched:
            for old in sorted(held[b])[: len(held[b]) + 1 - keep]:
                _remove(spark, f"{path}/bucket={b}/version={old}")
        return version
    finally:
        placed.unpersist()


def state(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of each bucket's newest version below ``path``; none where nothing was written."""
    held = _versions(spark, path, schema)
    return _read(spark, path, schema, [f for versions in held.values() for f in versions[max(versions)]])


def keep_latest(stream: DataFrame, key: list[str], order: list[str], path: str, checkpoint: str, buckets: int = 64, keep: int = 2, whole: bool = False, snapshots: str | None = None, frame: str = "frame_id", kept_snapshots: int | None = 2) -> StreamingQuery:
    """Upserts each micro-batch into the state below ``path``. With ``snapshots``, the whole fused state
    is published there after each batch as version=<n>, of which the last ``kept_snapshots`` stay (None: all)."""

    def update(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        version = upsert(batch, key, order, path, buckets, keep, whole)
        if version is None or snapshots is None:
            return
        fused(state(spark, path, batch.schema), order, frame).write.mode("overwrite").parquet(f"{snapshots}/version={version}")
        if kept_snapshots is not None and version >= kept_snapshots:
            _remove(spark, f"{snapshots}/version={version - kept_snapshots}")

    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

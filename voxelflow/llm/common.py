"""What several operators share: tables, shared-folder checkpoints, text helpers, components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Spark's setting for removing the shuffle files of a query when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Edges up to which the planner may send a round of ``components`` through the driver; it goes by compressed files.
SMALL = 1 << 16
_ASCII_WORD = re.compile(WORD)
#: White space that str.split() knows and WORD does not.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_words(text: str) -> list[str]:
    """The words of a text, as WORD defines them."""
    return _ASCII_WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


class WordHashes(dict):
    """Memo of word -> XXH64. It forgets everything at ``limit`` words, so its memory is bounded."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one is made only on a single machine without it (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
        if not found:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="voxelflow-")
            spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, what: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark)}/voxelflow/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the JVM may be gone already
        pass


def materialize(df: DataFrame, what: str, by: str | None = None, buckets: int = 0) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here and
    survives lost executors. The table goes by ``discard`` or when the driver ends, the shuffle
    files behind it go as soon as it is written. ``by``: the table lies in ``buckets`` of that
    column, and grouping or joining by it doesn't shuffle the table."""
    spark = df.sparkSession
    path, before = new_path(spark, what), spark.conf.get(_CLEAN, "false")
    name = "voxelflow_" + re.sub(r"\W", "_", path.rsplit("/", 1)[1])
    spark.conf.set(_CLEAN, "true")
    try:
        if by:
            df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, by).saveAsTable(name)
        else:
            df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    found = spark.table(name) if by else spark.read.schema(df.schema).parquet(path)

    def drop():
        try:
            if by:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # the JVM may be gone already
            pass
        remove(spark, path)

    found._drop = drop
    atexit.register(drop)
    return found


def discard(*tables: DataFrame) -> None:
    """Removes materialized tables that no later step reads."""
    for x in tables:
        x._drop()
        atexit.unregister(x._drop)


def _other(column: str):
    """A key that equals another just when ``column`` does. The planner deals it out by a new
    exchange, whose large partitions adaptive execution may split."""
    return F.col(column).bitwiseXOR(F.lit(1))


def row_key(docs: DataFrame) -> Column:
    """A hash of the whole row, nulls and their places included."""
    return F.xxhash64(*docs.columns, *[F.col(c).isNull() for c in docs.columns])


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u long, v long): (node, component), component the smallest
    node. Alternating large-star and small-star rounds, each materialized; a node without edges
    does not appear. Rounds grow with the logarithm of the largest component."""
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, seen = materialize(now, "edges"), None

    def hub(rows: DataFrame, edges: int) -> DataFrame:
        least = rows.groupBy("u").agg(F.min("v").alias("m")).select(_other("u").alias("k"), F.least(F.col("m"), F.col("u")).alias("m"))
        return rows.withColumn("k", _other("u")).join(least if edges <= SMALL else least.hint("merge"), "k").select("u", "v", "m")

    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", "u"))).head()
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).distinct()
        seen, last = mark, now
        both = now.union(now.select("v", "u"))
        large = hub(both, mark[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = hub(large, mark[0])
        small = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select("v", "m")).where("u <> v").distinct()
        now = materialize(small, "edges")
        discard(last)

"""Cutting lineage between the rounds of iterative operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one is made only on a single machine without it (tests)."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="voxelflow-")
        context.setCheckpointDir(found)
    return found


def remove(spark: SparkSession, path: str) -> None:
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the JVM may be gone already
        pass


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back. A table and no checkpoint: a
    checkpoint keeps the estimated size of what it was made from, which multiplies with every join, and
    after some rounds the planner is busy with numbers of a million digits; a table has the size it has,
    so small sides are broadcast. Tables go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/voxelflow/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)

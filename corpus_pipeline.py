"""The corpus pipeline: quality rules, near-dedup, PII, mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a
DataFrame; all but the last return the columns of ``docs``. Stages: documents that the quality
rules reject go; one document of each near-duplicate group stays; personal data is replaced by
its kind; each document comes as often as the mix takes it; the rest is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelflow.llm import mixing, neardup, packing, pii, quality_rules
from voxelflow.llm.common import discard, materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask_private(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.resample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("pii", private), ("mixing", mix), ("packing", pack)]

#: No SQL expresses the packing program; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = last = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if name != STAGES[0][0]:
            discard(last)
        last = docs
    return docs

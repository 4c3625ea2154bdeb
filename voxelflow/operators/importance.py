"""Variable importance of a forest by permutation, for all columns in one pass.

Rows are held out of the fit by a hash of their id. Each held-out row meets each column once with
another row's value in it, the donor's: rows stand on a ring in the order of a hash, and the donor for
column c stands STEP * (c + 1) places on. So each column's values are permuted, and donors come by one
equi-join on the place. A column's importance is the accuracy that its permutation costs."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelflow.operators import forest
from voxelflow.operators.decode import argmax
from voxelflow.operators.lineage import cut
from voxelflow.operators.supervoxel import numbered

STEP = 7919


def _order(id: str) -> Column:
    return F.md5(F.concat(F.lit("oob:"), F.col(id).cast("string")))


def held_out(id: str, share: int = 3) -> Column:
    """Whether a row is left out of the fit: one in ``share`` by the first eight digits of its hash."""
    return F.coalesce(F.conv(F.substring(_order(id), 1, 8), 16, 10).cast("long") % share == 0, F.lit(False))


def swapped(rows: DataFrame, id: str, columns: int) -> DataFrame:
    """id, label, c, features, value, donor: each held-out row once for each column c, with the value
    that the row ``donor`` has there. Rows without an id take no part; ids are unique."""
    kept = rows.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), "label", "features", F.substring(_order(id), 1, 2).alias("_part"), _order(id).alias("_order"), F.lit(0).alias("_all"))
    ring = cut(numbered(kept, ["_all"], ["_part"], ["_order", "id"], "place").drop("_all", "_part", "_order"))
    n = ring.count()
    each = ring.select("id", "label", "features", "place", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("c"))
    each = each.withColumn("from", (F.col("place") - 1 + STEP * (F.col("c") + 1)) % max(1, n) + 1)
    donors = ring.select(F.col("id").alias("donor"), F.col("place").alias("from"), F.posexplode(F.slice("features", 1, columns)).alias("c", "value"))
    return each.join(donors, ["from", "c"]).select("id", "label", "c", "features", "value", "donor")


def importance(model: RandomForestClassificationModel, rows: DataFrame, id: str, columns: int) -> DataFrame:
    """c, accuracy, permuted, importance of each column over held-out rows (id, features, label >= 0)."""
    labelled = rows.where("label >= 0")
    right = lambda: F.avg((argmax(F.col("prob")) == F.col("label")).cast("double"))
    base = forest.posterior(model, labelled).agg(right().alias("accuracy"))  # one row
    other = swapped(labelled, id, columns)
    other = other.withColumn("features", F.transform("features", lambda v, k: F.when(k == F.col("c"), F.col("value")).otherwise(v)))
    permuted = forest.posterior(model, other).groupBy("c").agg(right().alias("permuted"))
    return permuted.crossJoin(F.broadcast(base)).select("c", "accuracy", "permuted", (F.col("accuracy") - F.col("permuted")).alias("importance"))


def fit_and_rank(rows: DataFrame, id: str, columns: int, share: int = 3, **more) -> tuple[RandomForestClassificationModel, DataFrame]:
    """A forest fitted on the rows that are not held out, and the importance of its columns over those that are."""
    marked = rows.withColumn("_out", held_out(id, share))
    model = forest.fit(marked.where("not _out"), **more)
    return model, importance(model, marked.where("_out").drop("_out"), id, columns)

"""Camera calibrations as a table: intrinsic (row-major), rotation, translation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelflow.functions import geometry as g

SCHEMA = "intrinsic array<double>, rotation struct<format:string,data:array<double>>, translation array<double>"


def read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """scene_id and calibration columns of JSON files, comments allowed: ``resolve``, and ``text``, the
    whole file. The scene is the file's name or, where a folder scene_id=<scene> holds the file, as
    ``write_rectified`` leaves it, that folder's."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("_file", F.col("_metadata.file_path"))
    named = F.regexp_extract("_file", r"/scene_id=([^/]+)/[^/]*$", 1)
    scene = F.url_decode(F.replace(F.when(named != "", named).otherwise(F.regexp_extract("_file", r"([^/]+)\.[^./]+$", 1)), F.lit("+"), F.lit("%2B")))
    rows = files.select(scene.alias("scene_id"), F.col("value").alias("text"), F.from_json("value", SCHEMA, {"allowComments": "true", "mode": "FAILFAST"}).alias("c"))
    return resolve(rows.select("scene_id", "text", "c.*"))


def resolve(rows: DataFrame) -> DataFrame:
    """scene_id, k, k_inverse, rotation (9, row-major), rigid (rotation * k_inverse), t.

    Formats: q3 (x, y, z; w follows), q4 (x, y, z, w), m33 (column-major); others raise, and so do
    missing values. Of the translation only z is used."""
    at = lambda c, i: F.get(F.col(c), F.lit(i))
    d = [F.get(F.col("rotation.data"), F.lit(i)) for i in range(9)]
    kind = F.col("rotation.format")
    w = F.when(kind == "q3", F.sqrt(1 - d[0] * d[0] - d[1] * d[1] - d[2] * d[2])).otherwise(d[3])
    turned = g.quaternion_matrix(d[0], d[1], d[2], w)
    given = [d[3 * (i % 3) + i // 3] for i in range(9)]
    bad = F.raise_error(F.concat(F.lit("rotation format: "), F.coalesce(kind, F.lit("none")))).cast("array<double>")
    rotation = F.when(kind.isin("q3", "q4"), F.array(*turned)).when(kind == "m33", F.array(*given)).otherwise(bad)
    k = [at("intrinsic", i) for i in range(9)]
    complete = (F.size("intrinsic") == 9) & (F.size("translation") == 3)
    kept = ["text"] if "text" in rows.columns else []
    rows = rows.select("scene_id", *kept, F.when(F.coalesce(complete, F.lit(False)), F.col("intrinsic")).otherwise(F.raise_error(F.lit("incomplete calibration")).cast("array<double>")).alias("k"), F.array(*g.inverse(k)).alias("k_inverse"), rotation.alias("rotation"), F.array(F.lit(0.0), F.lit(0.0), at("translation", 2)).alias("t"))
    r, inv = ([at(c, i) for i in range(9)] for c in ("rotation", "k_inverse"))
    return rows.withColumn("rigid", F.array(*g.product(r, inv)))


def to_json(rows: DataFrame) -> Column:
    """A calibration as JSON text, the rotation as m33. Other keys of the file it was read from (column
    ``text``) are kept."""
    r = [F.get(F.col("rotation"), F.lit(3 * (i % 3) + i // 3)) for i in range(9)]
    own = {"intrinsic": F.col("k"), "rotation": F.struct(F.lit("m33").alias("format"), F.array(*r).alias("data")), "translation": F.col("t")}
    if "text" not in rows.columns:
        return F.to_json(F.struct(*[v.alias(k) for k, v in own.items()]))
    given = F.from_json("text", "variant", {"allowComments": "true"}).cast("map<string,variant>")
    new = F.create_map(*[x for k, v in own.items() for x in (F.lit(k), F.to_variant_object(v))])
    return F.to_json(F.map_concat(F.map_filter(F.coalesce(given, F.create_map().cast("map<string,variant>")), lambda k, v: ~k.isin(*own)), new))


def rectified_path(path: str) -> str:
    """The sibling folder for rectified calibrations: <folder>_rect."""
    return path.rstrip("/") + "_rect"


def write_rectified(rows: DataFrame, path: str) -> str:
    """Writes the JSON of ``rows`` (resolved, with the new rotation and t) below the sibling of
    ``path``, one folder per scene; returns that sibling."""
    there = rectified_path(path)
    rows.select("scene_id", to_json(rows).alias("value")).write.mode("overwrite").partitionBy("scene_id").text(there)
    return there

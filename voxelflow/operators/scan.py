"""The composite scan: from folders of images and calibrations to training rows, scene by scene.

Scenes are listed in sets, test before train; one that is in several counts in the first. A report joins the
list with the files that exist, outer on both sides, so nothing is missed silently. Complete scenes
are worked off in groups; a group's rows replace the scenes' partitions and only then its scenes count
as done, so a scan that was cut short goes on where it stood, and one that runs again does nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelflow.operators import scene
from voxelflow.sources import calibration, clouds, images

KINDS = ("depth", "color", "label", "calibration", "voxel")
COMPLETE, INCOMPLETE, UNLISTED = "complete", "incomplete", "unlisted"


def scene_sets(spark: SparkSession, sets: list[tuple[str, list[str]]]) -> DataFrame:
    """scene_set, scene_id, ord of the sets in their order; a scene belongs to the first that lists it."""
    rows = [(name, s, k) for k, (name, names) in enumerate(sets) for s in names]
    listed = spark.createDataFrame(rows, "scene_set string, scene_id string, ord int")
    return listed.groupBy("scene_id").agg(F.min_by("scene_set", "ord").alias("scene_set"), F.min("ord").alias("ord")).select("scene_set", "scene_id", "ord")


def present(spark: SparkSession, folders: dict[str, str], endings: dict[str, str]) -> DataFrame:
    """scene_id, kind of the files in the folders of each kind; their contents are not read."""

    def files(kind: str) -> DataFrame:
        try:
            found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{endings[kind]}").load(folders[kind]).select("path")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            found = spark.createDataFrame([], "path string")
        return found.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("scene_id"), F.lit(kind).alias("kind"))

    return reduce(DataFrame.unionByName, [files(kind) for kind in folders])


def report(wanted: DataFrame, found: DataFrame, kinds: list[str]) -> DataFrame:
    """scene_id, status, missing (kinds, comma-joined in their order) of each scene that is listed or
    has a file. wanted: scene_id; found: scene_id, kind, repeats allowed; files of other kinds don't count."""
    held = found.where(F.col("kind").isin(*kinds)).groupBy("scene_id").agg(F.collect_set("kind").alias("held"))
    both = wanted.select("scene_id").distinct().withColumn("_listed", F.lit(True)).join(held, "scene_id", "full")
    lacks = F.filter(F.array(*[F.lit(k) for k in kinds]), lambda k: ~F.array_contains(F.coalesce("held", F.array().cast("array<string>")), k))
    both = both.withColumn("missing", F.concat_ws(",", lacks))
    status = F.when(F.col("_listed").isNull(), UNLISTED).when(F.col("missing") == "", COMPLETE).otherwise(INCOMPLETE)
    return both.select("scene_id", status.alias("status"), "missing")


def load_members(spark: SparkSession, scenes: list[str], folders: dict[str, str], endings: dict[str, str], taxonomy: DataFrame, rectified: bool = True) -> tuple[DataFrame, DataFrame]:
    """(members with labels, origins) of some scenes from their files, and of no others' files."""
    at = lambda kind: [f"{folders[kind]}/{s}{endings[kind]}" for s in scenes]
    camera = calibration.read(spark, at("calibration"))
    cloud = clouds.create_cloud(images.load_depth(spark, at("depth")), images.load_color(spark, at("color")), images.load_label(spark, at("label"), taxonomy), camera, rectified)
    return scene.members_of_image(cloud, images.load_voxel(spark, at("voxel"))), clouds.origins(camera, rectified)


def scan(spark: SparkSession, wanted: DataFrame, folders: dict[str, str], endings: dict[str, str], taxonomy: DataFrame, out: str, group: int = 64, edges: DataFrame | None = None, min_points: int = 10, rectified: bool = True) -> list[str]:
    """Works off the scenes of ``wanted`` (scene_id, ord; see scene_sets) that are complete and not done,
    ``group`` at a time, and returns their names. Below ``out``: rows (scene_id, vid, n, label,
    features) partitioned by scene, done, and the report of this run. The list of scene names is all that
    reaches the driver."""
    found = report(wanted, present(spark, folders, endings), list(folders))
    found.write.mode("overwrite").parquet(f"{out}/report")
    found = spark.read.parquet(f"{out}/report")
    try:
        done = spark.read.parquet(f"{out}/done")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        done = spark.createDataFrame([], "scene_id string")
    todo = wanted.join(found.where(F.col("status") == COMPLETE), "scene_id", "left_semi").join(done, "scene_id", "left_anti")
    names = [r["scene_id"] for r in todo.orderBy("ord", "scene_id").collect()]
    for start in range(0, len(names), group):
        some = names[start : start + group]
        members, _ = load_members(spark, some, folders, endings, taxonomy, rectified)
        rows = scene.training_rows(members, ["scene_id", "vid"], edges=edges, min_points=min_points)
        rows.select("scene_id", "vid", "n", "label", "features").repartition("scene_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scene_id").parquet(f"{out}/rows")
        spark.createDataFrame([(s,) for s in some], "scene_id string").coalesce(1).write.mode("append").parquet(f"{out}/done")
    return names

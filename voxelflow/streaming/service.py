"""Requests to label a cloud, as a stream joined with static tables.

A request names a waypoint and perhaps an instance (instance_number null: the whole waypoint). It needs a
cloud, a sensor origin and a supervoxel that is large enough; what lacks one of them is answered by
a row that says so, never by an error. Requests that can be answered are labelled together: the
forest's posterior, spread to the points of each supervoxel, smoothed by the CRF."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxelflow.operators import decode, scene
from voxelflow.sources import clouds as sources

OK, NO_CLOUD, NO_ORIGIN, NO_SUPERVOXEL = "ok", "no cloud", "no origin", "no supervoxel"


def cloud_sizes(clouds: DataFrame, min_points: int = 10) -> DataFrame:
    """waypoint_id, wanted, n_all, n_points: points of each waypoint (wanted null) and of each of its
    instances, and those of them in supervoxels that are large enough."""
    rows = clouds.select("waypoint_id", "vid", F.explode(F.array_distinct(F.array(F.lit(None).cast("long"), F.col("instance_number").cast("long")))).alias("wanted"))
    voxels = rows.groupBy("waypoint_id", "wanted", "vid").agg(F.count("*").alias("n"))
    return voxels.groupBy("waypoint_id", "wanted").agg(F.sum("n").alias("n_all"), F.sum(F.when(F.col("n") >= min_points, F.col("n")).otherwise(0)).alias("n_points"))


def outcomes(requests: DataFrame, clouds: DataFrame, origins: DataFrame, min_points: int = 10) -> DataFrame:
    """request_id, waypoint_id, instance_number, status, n_points of each request, a batch or a stream.
    clouds: waypoint_id, instance_number, vid and more; origins: waypoint_id, ox, oy, oz. The first
    reason counts, in the order cloud, origin, supervoxel; n_points is 0 unless the status is ok."""
    sizes = cloud_sizes(clouds, min_points).withColumnRenamed("waypoint_id", "_waypoint")
    known = origins.select(F.col("waypoint_id").alias("_origin")).distinct()
    rows = requests.select("request_id", "waypoint_id", F.col("instance_number").cast("long").alias("instance_number"))
    rows = rows.join(sizes, (F.col("waypoint_id") == F.col("_waypoint")) & F.col("instance_number").eqNullSafe(F.col("wanted")), "left")
    rows = rows.join(known, F.col("waypoint_id") == F.col("_origin"), "left")
    status = F.when(F.col("n_all").isNull(), NO_CLOUD).when(F.col("_origin").isNull(), NO_ORIGIN).when(F.col("n_points") == 0, NO_SUPERVOXEL).otherwise(OK)
    rows = rows.withColumn("status", status)
    return rows.select("request_id", "waypoint_id", "instance_number", "status", F.when(F.col("status") == OK, F.col("n_points")).otherwise(0).alias("n_points"))


def answers(requests: DataFrame, clouds: DataFrame, origins: DataFrame, model: RandomForestClassificationModel | DataFrame, classes: int, min_points: int = 10, **more) -> tuple[DataFrame, DataFrame]:
    """(labelled points, label frequencies) of the requests that can be answered, by request_id. clouds:
    waypoint_id, instance_number, vid, idx, x, y, z, r, g, b; a model that is a table of posteriors has
    waypoint_id (here the request), vid and prob. Points are relative to the origin, as in training."""
    good = outcomes(requests, clouds, origins, min_points).where(F.col("status") == OK).select("request_id", F.col("waypoint_id").alias("_waypoint"), F.col("instance_number").alias("_wanted"))
    centred = sources.centred(sources.with_origin(clouds, origins.dropDuplicates(["waypoint_id"]), ["waypoint_id"]))
    members = centred.join(good, (F.col("waypoint_id") == F.col("_waypoint")) & (F.col("_wanted").isNull() | (F.col("_wanted") == F.col("instance_number"))))
    members = members.select(F.col("request_id").alias("waypoint_id"), "vid", "idx", "x", "y", "z", "r", "g", "b")
    points, frequencies = scene.label_cloud(members, model, classes, min_points=min_points, **more)
    return points.withColumnRenamed("waypoint_id", "request_id"), frequencies.withColumnRenamed("waypoint_id", "request_id")


def report_outcomes(stream: DataFrame, clouds: DataFrame, origins: DataFrame, path: str, checkpoint: str, min_points: int = 10) -> StreamingQuery:
    """The outcome of each request of the stream, appended to the table at ``path``: a stream-static
    join, without state."""
    found = outcomes(stream, clouds, origins, min_points)
    return found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def serve(stream: DataFrame, clouds: DataFrame, origins: DataFrame, model: RandomForestClassificationModel | DataFrame, classes: int, path: str, checkpoint: str, min_points: int = 10, **more) -> StreamingQuery:
    """Answers each micro-batch of requests below ``path``: outcomes, points and frequencies, each in a
    folder batch=<n>, which a batch that runs again writes again."""

    def answer(batch: DataFrame, number: int) -> None:
        requests = batch.persist()
        try:
            outcomes(requests, clouds, origins, min_points).write.mode("overwrite").parquet(f"{path}/outcomes/batch={number}")
            points, _ = answers(requests, clouds, origins, model, classes, min_points, **more)
            points.write.mode("overwrite").parquet(f"{path}/points/batch={number}")
            written = requests.sparkSession.read.schema(points.schema).parquet(f"{path}/points/batch={number}")
            decode.label_frequencies(written, ["request_id"]).write.mode("overwrite").parquet(f"{path}/frequencies/batch={number}")
        finally:
            requests.unpersist()

    return stream.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

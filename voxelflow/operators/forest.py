"""Random forest on feature arrays: fit, posterior, save, load."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelflow.operators import growing
from voxelflow.operators.lineage import cut, remove, shared_folder

#: Ranks at which a feature's values are looked at for thresholds.
_FINE = 2048


def class_distribution(rows: DataFrame) -> DataFrame:
    return rows.where("label >= 0").groupBy("label").agg(F.count("*").alias("n"))


def _thresholds(rows: DataFrame, n: int) -> list[np.ndarray]:
    """For each feature up to 31 values that part its rows into intervals of about equal numbers; of a
    feature of few values all but the last."""
    each = rows.select(F.posexplode("features").alias("f", "x"))
    odd = F.count_if(F.col("x").isNull() | F.isnan("x") | (F.abs("x") == float("inf")))
    fine = F.percentile_approx("x", [k / _FINE for k in range(1, _FINE)], 10000)
    found = each.groupBy("f").agg(F.count("*").alias("n"), odd.alias("odd"), F.max("x").alias("most"), fine.alias("fine")).orderBy("f").collect()
    if not found or any(r["n"] != n or r["odd"] for r in found):
        raise ValueError("features must be arrays of one length without nulls, NaN or infinite values")
    out = []
    for r in found:
        few = np.unique(r["fine"])
        cuts = few if len(few) < growing.BINS else np.unique(np.array(r["fine"])[_FINE // growing.BINS - 1 :: _FINE // growing.BINS])
        out.append(cuts[cuts < r["most"]])
    return out


def _blocks(thresholds: list[np.ndarray]) -> Callable:
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch["features"].flatten().to_numpy().reshape(batch.num_rows, -1)
            bins = np.stack([np.searchsorted(t, values[:, f]) for f, t in enumerate(thresholds)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"ids": [batch["id"].to_numpy().tobytes()], "labels": [batch["label"].to_numpy().astype(np.int32).tobytes()], "bins": [bins.tobytes()]}, pa.schema([(c, pa.binary()) for c in ("ids", "labels", "bins")]))

    return run


def fit(training: DataFrame, trees: int = 64, depth: int = 30, min_split: int = 30, seed: int = 0, group: int = growing.GROUP) -> RandomForestClassificationModel:
    """training: features (array<double>), label (unlabelled rows, < 0, are left out). A node of
    fewer than min_split rows is not split as long as its children would be about half of it.

    The nodes grow as ``growing`` says (Spark's learner takes the same time for each node, small ones
    too) and are saved as a model of Spark, which is loaded."""
    spark, least = training.sparkSession, max(1, min_split // 2)
    rows = cut(training.where("label >= 0").select(F.monotonically_increasing_id().alias("id"), F.col("features").cast("array<double>").alias("features"), F.col("label").cast("int").alias("label")))
    n, most, missing = rows.agg(F.count("*"), F.max("label"), F.count_if(F.col("features").isNull())).head()
    if not n or missing:
        raise ValueError("no labelled rows" if not n else "features must not be null")
    thresholds = _thresholds(rows, n)
    blocks = cut(rows.mapInArrow(_blocks(thresholds), growing.BLOCK))
    shape = growing.Shape(trees, depth, least, seed, len(thresholds), most + 1, group)
    found = growing.tops(blocks, n, shape)
    below = cut(growing.subtrees(blocks, found, shape))

    # numbers: the top's nodes, then those of each group without its root, which is a node of the top
    sizes = {(r["tree"], r["node"]): r["count"] for r in below.groupBy("tree", "node").count().collect()}
    above, places = [], []
    for t, top in enumerate(found):
        end = len(top.links)
        for k, (link, stats, gain) in enumerate(zip(top.links, top.stats, top.gain, strict=True)):
            if (t, k) in sizes:
                places.append((t, k, end - 1))
                end += sizes[t, k] - 1
            else:
                above.append((t, k, *link, [0.0] * shape.classes if stats is None else stats.tolist(), gain))
    number = lambda c: F.when(F.col(c) < 0, -1).when(F.col(c) == 0, F.col("node")).otherwise(F.col(c) + F.col("place"))
    columns = ["feature", "bin", "stats", "gain"]
    below = below.join(F.broadcast(spark.createDataFrame(places, "tree int, node int, place int")), ["tree", "node"]).select("tree", number("id").alias("id"), number("left").alias("left"), number("right").alias("right"), *columns)
    above = spark.createDataFrame(above, "tree int, id int, feature int, bin int, left int, right int, stats array<double>, gain double")
    return _model(above.select(below.columns).union(below), thresholds, shape)


def _model(nodes: DataFrame, thresholds: list[np.ndarray], shape: growing.Shape) -> RandomForestClassificationModel:
    """The nodes as a saved model, loaded."""
    spark = nodes.sparkSession
    path = f"{shared_folder(spark)}/voxelflow/forest-{uuid.uuid4().hex}"
    same = {"featuresCol": "v", "labelCol": "label", "maxDepth": shape.depth, "minInstancesPerNode": shape.least, "seed": shape.seed}
    described = []
    for k, learner in enumerate((RandomForestClassifier(numTrees=shape.trees, featureSubsetStrategy="sqrt", bootstrap=True, subsamplingRate=1.0, **same), DecisionTreeClassifier(**same))):
        learner.save(f"{path}/learner{k}")
        described.append(json.loads(spark.read.text(f"{path}/learner{k}/metadata").head()[0]))
    forest, tree = described
    forest |= {"class": "org.apache.spark.ml.classification.RandomForestClassificationModel", "numFeatures": shape.features, "numClasses": shape.classes, "numTrees": shape.trees}
    tree["class"] = "org.apache.spark.ml.classification.DecisionTreeClassificationModel"
    each = [(t, json.dumps(tree | {"uid": f"{tree['uid']}_{t}"}), 1.0) for t in range(shape.trees)]
    spark.createDataFrame([(json.dumps(forest),)], "value string").coalesce(1).write.text(f"{path}/model/metadata")
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/model/treesMetadata")

    cuts = spark.createDataFrame([(f, b, float(x)) for f, t in enumerate(thresholds) for b, x in enumerate(t)], "feature int, bin int, threshold double")
    total = F.aggregate("stats", F.lit(0.0), lambda a, x: a + x)
    square = F.aggregate("stats", F.lit(0.0), lambda a, x: a + x * x)
    data = nodes.join(F.broadcast(cuts), ["feature", "bin"], "left").select(
        F.col("tree").alias("treeID"),
        F.struct(
            "id", (F.array_position("stats", F.array_max("stats")) - 1).cast("double").alias("prediction"), F.when(total > 0, 1 - square / (total * total)).otherwise(0.0).alias("impurity"), F.col("stats").alias("impurityStats"),
            total.cast("long").alias("rawCount"), "gain", F.col("left").alias("leftChild"), F.col("right").alias("rightChild"),
            F.struct(F.col("feature").alias("featureIndex"), F.when(F.col("feature") < 0, F.array().cast("array<double>")).otherwise(F.array("threshold")).alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories")).alias("split"),
        ).alias("nodeData"),
    )
    data.write.parquet(f"{path}/model/data")
    found = load(f"{path}/model")
    remove(spark, path)
    return found


def posterior(model: RandomForestClassificationModel, rows: DataFrame) -> DataFrame:
    """Adds prob (array<double>)."""
    found = model.transform(rows.withColumn("v", array_to_vector("features")))
    return found.withColumn("prob", vector_to_array("probability")).drop("v", "rawPrediction", "probability", "prediction")


def save(model: RandomForestClassificationModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> RandomForestClassificationModel:
    return RandomForestClassificationModel.load(path)

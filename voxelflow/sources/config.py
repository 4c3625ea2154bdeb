"""Configuration, command line and label taxonomy: small, on the driver."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_COMMENT = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', re.S)
_MISSING = object()


def parse_json(text: str) -> Any:
    """JSON that may hold // and /* */ comments."""
    return json.loads(_COMMENT.sub(lambda m: m[0] if m[0][0] == '"' else " ", text))


def parse_arguments(arguments: list[str]) -> dict[str, str] | None:
    """--key value pairs, the last of a key wins; None where a key lacks its dashes."""
    found = {}
    for i in range(0, len(arguments), 2):
        if not arguments[i].startswith("--"):
            return None
        if i + 1 == len(arguments):
            raise ValueError(f"{arguments[i]} lacks a value")
        found[arguments[i][2:]] = arguments[i + 1]
    return found


class Config:
    """Values by key; overrides are parsed as JSON where they are JSON, else taken as text."""

    def __init__(self, values: dict[str, Any], overrides: dict[str, str] | None = None, root_key: str = "root_dir"):
        self.values = dict(values)
        for key, text in (overrides or {}).items():
            try:
                self.values[key] = json.loads(text)
            except ValueError:
                self.values[key] = text
        self.root = self.values.get(root_key, "")

    @classmethod
    def read(cls, spark: SparkSession, path: str, overrides: dict[str, str] | None = None) -> Config:
        """From a file in any store that Spark reads."""
        text = spark.read.text(path, wholetext=True).head()
        if text is None:
            raise ValueError(f"{path} is empty")
        return cls(parse_json(text[0]), overrides)

    def get(self, key: str, kind: type = str, default: Any = _MISSING) -> Any:
        """The value as bool, int, float or str; lists element by element. A missing key raises
        KeyError unless there is a default."""
        if key not in self.values:
            if default is _MISSING:
                raise KeyError(key)
            return default
        value = self.values[key]
        return [kind(v) for v in value] if isinstance(value, list) else kind(value)

    def from_file(self, spark: SparkSession, key: str, kind: type = str) -> Any:
        """The value of ``key`` in the JSON file that ``key`` names here."""
        return Config.read(spark, self.path(key)).get(key, kind)

    def path(self, key: str) -> str:
        return self.root + str(self.values[key])

    def scenes(self, spark: SparkSession, key: str) -> DataFrame:
        """scene_id of a list of scenes."""
        return spark.createDataFrame([(x,) for x in self.get(key)], "scene_id string")


def overlaid(base: Column, over: dict[str, Column]) -> Column:
    """A map column with overrides: an override that is not null wins over the base's value of its
    key, one that is null leaves the base alone; a null base has no values."""
    kind = "map<string,long>"
    given = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in over]), F.array(*over.values())).cast(kind), lambda k, v: v.isNotNull())
    kept = F.map_filter(F.coalesce(base, F.create_map().cast(kind)), lambda k, v: ~F.map_contains_key(given, k))
    return F.map_concat(kept, given)


TAXONOMY = "ord int, name string, label int, r int, g int, b int"


def taxonomy(spark: SparkSession, entries: list[dict[str, Any]]) -> DataFrame:
    """TAXONOMY of [{name, color: [r, g, b], label}, ...]."""
    return spark.createDataFrame([(i, e["name"], int(e["label"]), *map(int, e["color"])) for i, e in enumerate(entries)], TAXONOMY)


def last_by_label(entries: DataFrame) -> DataFrame:
    """label, name, r, g, b of each label's last entry."""
    return entries.groupBy("label").agg(F.max_by(F.struct("name", "r", "g", "b"), "ord").alias("e")).select("label", "e.*")


def taxonomy_counts(entries: DataFrame) -> DataFrame:
    """One row: n_names (distinct names), n_labels (distinct labels >= 0)."""
    return entries.agg(F.countDistinct("name").alias("n_names"), F.countDistinct(F.when(F.col("label") >= 0, F.col("label"))).alias("n_labels"))


def frequency_report(frequencies: DataFrame, entries: DataFrame) -> DataFrame:
    """frequencies (keys.., label, freq) with the name of each label and a line "name : freq"."""
    named = frequencies.join(F.broadcast(last_by_label(entries).select("label", "name")), "label", "left")
    return named.withColumn("line", F.concat_ws(" : ", "name", F.col("freq").cast("string")))


def label_names(entries: DataFrame) -> list[str]:
    """Names by label >= 0."""
    return [r["name"] for r in last_by_label(entries).where("label >= 0").orderBy("label").collect()]


def colors_to_labels(pixels: DataFrame, entries: DataFrame, unknown: int | None = None) -> DataFrame:
    """Adds label by colour r, g, b. A colour that the taxonomy lacks raises, or gets ``unknown``."""
    table = F.broadcast(entries.groupBy("r", "g", "b").agg(F.max_by("label", "ord").alias("label")))  # a taxonomy: tens of rows
    found = pixels.join(table, ["r", "g", "b"], "left")
    fallback = F.raise_error(F.concat_ws(" ", F.lit("colour not in the taxonomy:"), "r", "g", "b")).cast("int") if unknown is None else F.lit(unknown)
    return found.withColumn("label", F.when(F.col("label").isNull(), fallback).otherwise(F.col("label")))


def labels_to_colors(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds name, r, g, b by label; a label that the taxonomy lacks raises."""
    found = rows.join(F.broadcast(last_by_label(entries)), "label", "left")
    missing = F.raise_error(F.concat(F.lit("label not in the taxonomy: "), F.col("label"))).cast("string")
    return found.withColumn("name", F.when(F.col("name").isNull(), missing).otherwise(F.col("name")))

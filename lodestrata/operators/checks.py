"""Held-out checks of predicted roles, identifiers of vectors, and saved models."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.numbers import shortest


def vector_id(source: str, path: str, vector: str) -> Column:
    """16 hexadecimal digits of the sha256 of source, path and vector, whose numbers are written as Python writes them."""
    numbers = F.array_join(F.transform(vector, shortest), ", ")
    return F.substring(F.sha2(F.concat_ws(":", source, path, F.concat(F.lit("["), numbers, F.lit("]"))), 256), 1, 16)


def against_known(predicted: DataFrame, known: DataFrame) -> DataFrame:
    """predicted (path, role) with expected and correct: the first pattern by rank that is the path or a dotted beginning of it.

    known (pattern, role, rank) meets the few paths of a schema through the paths' own beginnings, an equi-join.
    """
    parts = F.split("path", r"\.")
    begun = predicted.withColumn("pattern", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))))
    first = begun.join(known.select("pattern", F.col("role").alias("expected"), "rank"), "pattern").groupBy("path").agg(F.min_by("expected", "rank").alias("expected"))
    return predicted.join(first, "path", "left").withColumn("correct", F.col("role") == F.col("expected"))


def accuracy(checked: DataFrame) -> DataFrame:
    """One row: checked, correct, whole percent, decided by the classifier (a confidence other than 0.5), flagged."""
    seen = F.col("expected").isNotNull()
    out = checked.agg(F.count_if(seen).alias("checked"), F.count_if(seen & F.col("correct")).alias("correct"), F.count_if(F.col("confidence") != 0.5).alias("by_classifier"), F.count_if(F.col("confidence") < 0.6).alias("flagged"))
    return out.withColumn("percent", F.when(F.col("checked") > 0, F.floor(100 * F.col("correct") / F.col("checked"))))


def filled(features: DataFrame, least: int = 10) -> DataFrame:
    """Fields with at least so many values that aren't null."""
    return features.where(F.col("sample_count") - F.col("null_count") >= least)


def save(model: PipelineModel, path: str, about: dict | None = None) -> None:
    """The model in a folder, and beside it what `learning.stats` says of it."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(about or {}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load(path: str) -> tuple[PipelineModel, dict]:
    """The model of a folder and what was saved with it."""
    return PipelineModel.load(f"{path}/model"), json.loads(SparkSession.active().read.text(f"{path}/about").first().value)


class Models:
    """Models by source, in folders below one; each is loaded once."""

    def __init__(self, folder: str):
        self.folder, self.loaded = folder, {}

    def put(self, source: str, model: PipelineModel, about: dict | None = None) -> None:
        save(model, f"{self.folder}/{source}", about)
        self.loaded[source] = model, about or {}

    def get(self, source: str) -> tuple[PipelineModel | None, dict]:
        """The source's model and what is known of it; (None, {}) if it has none yet."""
        if source not in self.loaded:
            try:
                self.loaded[source] = load(f"{self.folder}/{source}")
            except (AnalysisException, Py4JJavaError):  # no such folder
                return None, {}
        return self.loaded[source]

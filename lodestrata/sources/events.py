"""Event folders, correction logs and sources named by numbered options."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.operators.learning import LABELS

#: What a source's options are where they aren't given. Fixed values.
DEFAULTS = {"index": "*", "format": "jsonl", "protocol": "udp", "poll_seconds": "5", "batch_size": "500", "verify_tls": "true"}
CORRECTION = "source_id string, field_path string, feature_vector_id string, correct_label string, type_hint string, original_label string, original_confidence double, timestamp string"
REQUIRED = ["source_id", "field_path", "feature_vector_id", "correct_label", "original_label", "original_confidence", "timestamp"]


def sources(options: dict[str, str], prefix: str = "SOURCE") -> dict[str, dict[str, str]]:
    """Options by source from names like SOURCE_1_TYPE; numbers in lexicographic order, those without TYPE left out."""
    groups: dict[str, dict[str, str]] = {}
    for name, setting in options.items():
        if m := re.fullmatch(rf"{prefix}_(\d+)_(\w+)", name):
            groups.setdefault(m[1], {})[m[2].lower()] = setting
    return {n: DEFAULTS | groups[n] for n in sorted(groups) if groups[n].get("type")}


def read_events(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(seq, payload, index): lines of text files whose names fit the pattern; seq rises with the file's path and the line in it.

    A line has its place from the split that Spark read it in: splits are few, and ranked by path and
    start; the lines themselves aren't moved or sorted. Numbers have gaps.
    """
    place = [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start")]
    files = spark.read.option("pathGlobFilter", pattern).text(path)
    lines = files.select(F.col("value").alias("payload"), F.col("_metadata.file_name").alias("index"), *place, F.monotonically_increasing_id().alias("_at"))
    ranks = files.select(*place).distinct().withColumn("_rank", F.row_number().over(Window.orderBy("_path", "_start")))  # a row for each split
    within = F.col("_at").bitwiseAND((1 << 33) - 1)  # the line's number in its task, below the task's own number
    return lines.join(ranks, ["_path", "_start"]).select((F.shiftleft(F.col("_rank").cast("long"), 33) + within).alias("seq"), "payload", "index")


def sample(events: DataFrame, n: int = 1000) -> DataFrame:
    """The first n events by seq."""
    return events.orderBy("seq").limit(n)


def append_corrections(corrections: DataFrame, path: str) -> None:
    """Add corrections (REQUIRED and type_hint) to a JSON log; labels that are none fail the write, confidences are rounded to 4 places."""
    checked = corrections.withColumn("correct_label", F.when(F.col("correct_label").isin(LABELS), F.col("correct_label")).otherwise(F.raise_error(F.concat(F.lit("invalid label: "), F.coalesce("correct_label", F.lit("null"))))))
    checked.withColumn("original_confidence", F.round("original_confidence", 4)).write.mode("append").json(path)


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """The log's corrections; blank and malformed lines and those without a required key are left out."""
    rows = spark.read.schema(CORRECTION + ", _broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    keep = F.col("_broken").isNull()
    for name in REQUIRED:
        keep = keep & F.col(name).isNotNull()
    return rows.where(keep).drop("_broken")

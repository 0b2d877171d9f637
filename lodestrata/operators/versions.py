"""Models of sources in numbered versions below a shared folder.

A version is a small file that names a model and holds its counters.  A model is written whole first; its
version then appears at once under the next number, or not at all where another writer was first.  A run
that breaks off leaves a model that no version names, and can be done again from the latest version.
"""

from __future__ import annotations

import hashlib
import json
import logging
import os
import uuid
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from lodestrata.sources import places

from . import learning

#: What a retrain ends with. Fixed values, but for LOST, which only several writers can meet.
DONE, TOO_FEW, NO_EXAMPLES, NO_LIBRARY, FAILED, LOST = range(6)


def home(folder: str, source_id: str) -> str:
    """The folder of a source, whatever characters its name has."""
    return f"{folder.rstrip('/')}/{hashlib.sha256(source_id.encode()).hexdigest()[:32]}"


def latest(folder: str, source_id: str) -> dict | None:
    """The record of the highest version of a source, None before the first."""
    versions = f"{home(folder, source_id)}/versions"
    try:
        names = [name for name, _ in places.listed(versions, "*.json")]
    except FileNotFoundError:
        return None
    if not names:
        return None
    files, base = places.located(versions)
    with files.open_input_stream(f"{base}/{max(names)}") as f:
        return json.loads(f.read())


def model_of(record: dict | None) -> PipelineModel | None:
    return PipelineModel.load(record["model"]) if record else None


def renamed(spark: SparkSession, from_path: str, to_path: str) -> bool:
    """Rename a file by Spark's own file systems unless there is one of the new name; False if there is."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    source, target = hadoop.Path(from_path), hadoop.Path(to_path)
    files = hadoop.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration())
    try:
        files.rename(source, target, spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
    except Exception as error:
        if "FileAlreadyExistsException" in str(error):
            return False
        raise
    return True


def appear(spark: SparkSession, from_path: str, to_path: str) -> bool:
    """Give a written file its name unless there is one of that name; False if there is.

    One step on local and mounted folders (a hard link) and on HDFS (a rename that does not overwrite).
    Object stores have no such step: versions need a folder of another kind.
    """
    if "://" in from_path and not from_path.startswith("file:"):
        return renamed(spark, from_path, to_path)
    source, target = places.located(from_path)[1], places.located(to_path)[1]
    try:
        os.link(source, target)
    except FileExistsError:
        return False
    os.unlink(source)
    return True


def commit(spark: SparkSession, folder: str, source_id: str, model: PipelineModel, counters: dict, expected: int) -> dict | None:
    """Make `model` the version after `expected`; its record, or None where that version is already there."""
    base = home(folder, source_id)
    path = f"{base}/models/{uuid.uuid4().hex}"
    model.write().save(path)
    return recorded(spark, folder, source_id, {**counters, "model": path}, expected)


def recorded(spark: SparkSession, folder: str, source_id: str, counters: dict, expected: int) -> dict | None:
    """Make a record with these counters the version after `expected`; None where that version is already there."""
    base = home(folder, source_id)
    record = {"created_at": datetime.now(timezone.utc).isoformat(), **counters, "version": expected + 1, "source_id": source_id}
    files, versions = places.located(f"{base}/versions")
    files.create_dir(versions, recursive=True)
    name = f".{uuid.uuid4().hex}"  # hidden from readers
    with files.open_output_stream(f"{versions}/{name}") as f:
        f.write(json.dumps(record).encode())
    return record if appear(spark, f"{base}/versions/{name}", f"{base}/versions/{expected + 1:012d}.json") else None


def retrained(spark: SparkSession, folder: str, source_id: str, examples: DataFrame, corrected: DataFrame, force: bool = False, dry_run: bool = False) -> tuple[int, dict | None]:
    """Train a source's next version from examples and corrections (label, feature_vector): what it ends with, and the record that counts then.

    TOO_FEW corrections (below the number needed, unless forced), NO_EXAMPLES, NO_LIBRARY to train with,
    FAILED by any other error (logged), LOST where another writer made the next version meanwhile; all
    leave the versions as they are.  So do a dry run, and a run with enough corrections of which too few
    are new since the last version; both are DONE.
    """
    record = None
    try:
        record = latest(folder, source_id)
        if examples.isEmpty():
            return NO_EXAMPLES, record
        corrections = corrected.count()
        if dry_run:
            return DONE, record
        if corrections < learning.NEW_CORRECTIONS and not force:
            return TOO_FEW, record
        before = record["correction_count"] if record else 0
        if not force and corrections - before < learning.NEW_CORRECTIONS:
            return DONE, record
        model = learning.train(examples.select("label", "feature_vector").unionByName(corrected.select("label", "feature_vector")))
        counters = learning.stats(source_id, model, examples.count() + corrections, corrections)
        made = commit(spark, folder, source_id, model, counters, record["version"] if record else 0)
        return (LOST, latest(folder, source_id)) if made is None else (DONE, made)
    except ImportError:
        logging.exception("no library to train %s with", source_id)
        return NO_LIBRARY, record
    except Exception:
        logging.exception("retraining %s failed", source_id)
        return FAILED, record

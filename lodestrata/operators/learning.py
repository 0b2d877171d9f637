"""Corrections, the forest of field roles, and density clusters of fields."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import features, roles

LABELS = ["entity", "metric", "enum", "temporal", "text", "unknown"]
#: Below this a prediction or an earlier confidence is flagged; corrections needed beyond the last training. Fixed values.
CERTAIN, NEW_CORRECTIONS = 0.6, 10


def validated(corrections: DataFrame, required: list[str]) -> DataFrame:
    """corrections with errors: missing keys, labels that are none, confidences outside 0 to 1."""
    checks = [F.when(F.col(k).isNull(), f"missing {k}") for k in required]
    checks += [F.when(~F.col("correct_label").isin(LABELS), "invalid label"), F.when(~F.col("original_confidence").between(0, 1), "confidence out of range")]
    return corrections.withColumn("errors", F.array_compact(F.array(*checks)))


def flagged(corrections: DataFrame, bound: float = CERTAIN) -> DataFrame:
    return corrections.where(F.coalesce("original_confidence", F.lit(1.0)) < bound)


def with_vectors(corrections: DataFrame, vectors: DataFrame) -> DataFrame:
    """corrections with the last vector stored for their path (vectors: path, line_no, feature_vector); zeros where there is none."""
    last = vectors.where("path is not null and feature_vector is not null").groupBy("path").agg(F.max_by("feature_vector", "line_no").alias("feature_vector"))
    joined = corrections.join(last, F.col("field_path") == F.col("path"), "left").drop("path")
    return joined.withColumn("feature_vector", F.coalesce("feature_vector", F.array_repeat(F.lit(0.0), len(features.NAMES))))


def bootstrap(spark: SparkSession, each: int = 12, size: int = 40) -> DataFrame:
    """(path, label, feature_vector): features of values made by rule, `each` fields of `size` values for every kind."""
    i, k = F.col("i"), F.col("k")
    h = F.md5(F.concat_ws("-", i, k))
    kinds = {
        "entity": F.when(k % 3 == 0, F.concat_ws(".", i % 223 + 1, k, i * 7 % 256, i * 13 % 256)).when(k % 3 == 1, F.concat(F.lit("node-"), i, F.lit(".site"), k, F.lit(".net"))).otherwise(h),
        "metric": (i * (k + 1) * F.lit(3.7)).cast("decimal(12,2)").cast("string"),
        "enum": F.element_at(F.array(*map(F.lit, ("low", "medium", "high"))), (i % 3 + 1).cast("int")),
        "temporal": F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + i * 977 + k * 86_400), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        "text": F.concat_ws(" ", F.lit("the unit reported that"), F.translate(h, "0123456789", "ghijklmnop"), F.lit("was seen again by the team on duty after the last change")),
    }
    rows = spark.range(each).withColumnRenamed("id", "k").crossJoin(spark.range(size).withColumnRenamed("id", "i"))  # each * size rows
    leaves = rows.select("k", "i", F.explode(F.create_map(*(x for name, value in kinds.items() for x in (F.lit(name), value.cast("string"))))).alias("label", "value"))
    table = features.vector(features.field_features(leaves.select(F.concat_ws("/", "label", "k").alias("path"), "value")))
    return table.select("path", F.split("path", "/")[0].alias("label"), "feature_vector")


def train(examples: DataFrame, trees: int = 100, seed: int = 42) -> PipelineModel | None:
    """A forest over (label, feature_vector) with balanced classes; None without examples."""
    counts = {r.label: r["count"] for r in examples.groupBy("label").count().collect()}  # a row for each label
    if not counts:
        return None
    total = sum(counts.values())
    weight = F.create_map(*(x for name, n in counts.items() for x in (F.lit(name), F.lit(total / (len(counts) * n)))))
    data = examples.select("label", array_to_vector("feature_vector").alias("features"), weight[F.col("label")].alias("weight"))
    indexer = StringIndexer(inputCol="label", outputCol="index").fit(data)
    forest = RandomForestClassifier(labelCol="index", featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=30, minInstancesPerNode=2, seed=seed)
    fitted = forest.fit(indexer.transform(data))
    return PipelineModel([fitted, IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels)])


def retrain(model: PipelineModel | None, examples: DataFrame, corrected: DataFrame, trained_on: int, force: bool = False, dry_run: bool = False) -> tuple[PipelineModel | None, str]:
    """The model after corrections (label, feature_vector), and what was done.

    `trained`; `skipped`, with the old model, where fewer than NEW_CORRECTIONS are new and it isn't forced;
    `empty` where there is nothing to learn from; `ready` where a dry run finds that it would train.
    """
    if not force and corrected.limit(trained_on + NEW_CORRECTIONS).count() - trained_on < NEW_CORRECTIONS:
        return model, "skipped"
    if dry_run:
        return model, "ready"
    new = train(examples.select("label", "feature_vector").unionByName(corrected.select("label", "feature_vector")))
    return (model, "empty") if new is None else (new, "trained")


def predict(model: PipelineModel | None, fields: DataFrame) -> DataFrame:
    """fields with label, confidence, is_entity and flagged (confidence below the bound).

    Without a model, and where a vector has another size than the features, all four are null.
    """
    fits = F.coalesce(F.size("feature_vector") == len(features.NAMES), F.lit(False))
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("label", "string"), ("confidence", "double"), ("is_entity", "boolean"), ("flagged", "boolean"))]
    if model is None:
        return fields.select("*", *none)
    out = model.transform(fields.where(fits).withColumn("features", array_to_vector("feature_vector")))
    confidence = F.array_max(vector_to_array("probability"))
    found = out.select(*fields.columns, F.col("predicted").alias("label"), confidence.alias("confidence"), (F.col("predicted") == "entity").alias("is_entity"), (confidence < CERTAIN).alias("flagged"))
    return found.unionByName(fields.where(~fits).select("*", *none))


def stats(source_id: str, model: PipelineModel | None, trained_on: int = 0, corrections: int = 0) -> dict:
    """What there is to say of a source's model: its state, classes, training rows, corrections and bounds."""
    classes = list(model.stages[-1].getLabels()) if model is not None else []
    return {"source_id": source_id, "model_status": "trained" if model is not None else "cold", "training_samples": trained_on, "correction_count": corrections, "feature_dim": len(features.NAMES), "confidence_threshold": CERTAIN, "min_corrections": NEW_CORRECTIONS, "classes": classes}


def decided(fields: DataFrame, predicted: DataFrame | None, found: DataFrame) -> DataFrame:
    """fields (path, role, samples, ..; by rule) with the role, is_entity, type_hint, confidence and cluster_id that count.

    predicted: path, label, confidence, flagged of the source's model, None if it has none yet: its label
    counts unless it is flagged, else the role by rule with a confidence of 0.5. found: path and cluster of
    `clusters`; noise (-1) has a confidence of 0.5, a field without a row there is unknown, in cluster -1
    with a confidence of 0.
    """
    out = fields.join(found.select("path", F.col("cluster").alias("cluster_id")), "path", "left")
    if predicted is None:
        label, sure = F.lit(None).cast("string"), F.lit(None).cast("double")
    else:
        out = out.join(predicted.where("not flagged").select("path", F.col("label").alias("_label"), F.col("confidence").alias("_sure")), "path", "left")
        label, sure = F.col("_label"), F.col("_sure")
    known = F.col("cluster_id").isNotNull()
    role = F.when(known, F.coalesce(label, "role")).otherwise("unknown")
    confidence = F.when(~known, 0.0).when(F.col("cluster_id") == -1, 0.5).otherwise(F.coalesce(sure, F.lit(0.5)))
    kept = [c for c in fields.columns if c not in ("role", "is_entity", "type_hint", "confidence", "cluster_id")]
    out = out.select(*kept, role.alias("role"), confidence.alias("confidence"), F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))
    return out.withColumn("is_entity", F.col("role") == "entity").withColumn("type_hint", F.when(F.col("is_entity"), roles.type_hint(F.col("samples"))))


def clusters(fields: DataFrame, source: str | None = None) -> DataFrame:
    """path, cluster (-1: noise), confidence of fields (path, feature_vector), each source (a column, if named) by itself.

    Columns are standardised, fields linked by mutual reachability (with one neighbour, plain distance),
    and the tree of merges cut where clusters of at least max(2, min(F // 10, 5)) fields keep most excess of
    mass.  Under 5 fields, all are noise. A task takes the fields of a source, a row for each path of its
    schema; memory grows with their number, time with its square (10,000 paths: some ten seconds).
    """
    rows = fields.select(F.lit("") if source is None else F.col(source).cast("string"), "path", "feature_vector").toDF("_source", "path", "feature_vector")

    def group(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("path")
        x = np.array(part["feature_vector"].tolist(), float).reshape(len(part), -1)
        labels = np.full(len(part), -1) if len(part) < 5 else excess_of_mass(x, max(2, min(len(part) // 10, 5)))
        return pd.DataFrame({"_source": part["_source"], "path": part["path"], "cluster": labels.astype(np.int32), "confidence": 0.5})

    out = rows.groupBy("_source").applyInPandas(group, "_source string, path string, cluster int, confidence double")
    return out.drop("_source") if source is None else out.withColumnRenamed("_source", source)


def spanning_tree(x: np.ndarray) -> list[tuple[float, int, int]]:
    """Links (distance, a, b) of a minimum spanning tree of the rows; distances are made for a row at a time."""
    n, links = len(x), []
    near, via, left = np.sqrt(((x - x[0]) ** 2).sum(axis=1)), np.zeros(n, int), np.ones(n, bool)
    left[0] = False
    for _ in range(n - 1):
        j = int(np.where(left, near, np.inf).argmin())
        links.append((float(near[j]), int(via[j]), j))
        left[j] = False
        d = np.sqrt(((x - x[j]) ** 2).sum(axis=1))
        closer = d < near
        near, via = np.where(closer, d, near), np.where(closer, j, via)
    return links


def excess_of_mass(x: np.ndarray, smallest: int) -> np.ndarray:
    """Cluster of each row, or -1, by hierarchical density with minimum spanning tree and excess of mass."""
    spread = x.std(axis=0)
    x = (x - x.mean(axis=0)) / np.where(spread == 0, 1, spread)
    n = len(x)
    # merges in order of distance: node n + i joins two nodes at a height
    parent, sizes, merges = list(range(2 * n - 1)), [1] * n, []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for height, a, b in sorted(spanning_tree(x)):
        a, b = root(a), root(b)
        parent[a] = parent[b] = n + len(merges)
        merges.append((a, b, max(height, 1e-12)))
        sizes.append(sizes[a] + sizes[b])
    # clusters from the top: [node, density at which it begins, mass, number of the cluster it comes out of]
    found, at = [[2 * n - 2, 0.0, 0.0, -1]], 0
    while at < len(found):
        node, born, mass, _ = found[at]
        while node >= n:
            a, b, height = merges[node - n]
            gone, big = 1 / height, [k for k in (a, b) if sizes[k] >= smallest]
            if len(big) == 1:  # the small side falls off, the cluster goes on
                mass, node = mass + sizes[a + b - big[0]] * (gone - born), big[0]
                continue
            mass += sizes[node] * (gone - born)
            found += [[k, gone, 0.0, at] for k in big]
            break
        found[at][2] = mass
        at += 1
    # from the ends: a cluster stays if it has no less mass than those that come out of it; the whole is none
    inner, chosen = [0.0] * len(found), [False] * len(found)
    for i in range(len(found) - 1, 0, -1):
        chosen[i] = found[i][2] >= inner[i]
        inner[found[i][3]] += max(found[i][2], inner[i])
    groups, covered = [], [False] * len(found)
    for i in range(1, len(found)):
        covered[i] = covered[found[i][3]]
        if chosen[i] and not covered[i]:
            covered[i], rows, stack = True, [], [found[i][0]]
            while stack:
                k = stack.pop()
                if k < n:
                    rows.append(k)
                else:
                    stack += merges[k - n][:2]
            groups.append(rows)
    out = np.full(n, -1)
    for number, rows in enumerate(sorted(groups, key=min)):
        out[rows] = number
    return out

"""Profiles that grow: a revision from the state of the one before and the new events alone.

The state of a source is a few tables, none of which grows with the events: sums for each path, counts of its
characters, of its lengths (up to the 1000 at which features cap them) and of the pairs of paths that
come together, its first ten values, the paths of the first ten events, and its values with their
counts as long as they are few. What adds up is exact for ever, and so is all that is told of a path
with few values. For one with more, the number of values is a HyperLogLog estimate and the commonest
shape comes from a frequent-items sketch; both sketches are kept for every path from its first event on.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.operators import features, relations, versions
from lodestrata.sources import places
from lodestrata.streaming import live

from . import profile

#: Distinct values that are kept of a path.
VALUES = 10_000
#: Registers of the distinct sketch, as a power of two: a standard error of 1.04 / sqrt(2^12), 1.6 %.
REGISTERS = 12
#: Shapes that a sketch follows. A count is off by at most 3.5 / 2048 of the path's values; where no shape is surely above
#: that, 1 stands for the commonest one's, which is then at most twice as much (see ERROR).
SHAPES = 1000
#: Largest error of format_consistency of a wide path.
ERROR = 7 / 2048
FIRST = 10
TABLES = ["paths", "values", "sizes", "chars", "samples", "pairs", "firsts"]


def _summed(rows: DataFrame, keys: list[str], count: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum(count).alias(count))


def _lowest(values: DataFrame) -> DataFrame:
    """The first ten distinct values of each path (path, value)."""
    ranked = values.distinct().withColumn("_r", F.row_number().over(Window.partitionBy("path").orderBy("value")))
    return ranked.where(F.col("_r") <= FIRST).drop("_r")


def _earliest(rows: DataFrame) -> DataFrame:
    """The (seq, path) of the first ten events."""
    seqs = rows.select("seq").distinct().orderBy("seq").limit(FIRST)
    return rows.join(seqs, "seq", "left_semi").distinct()


def _merged(paths: DataFrame) -> DataFrame:
    """A row for each path out of several that tell of parts of its values."""
    how = {"lo": F.min, "bottom": F.min, "hi": F.max, "top": F.max, "wide": F.max}
    sketches = {"distinct": lambda c: F.hll_union_agg(c), "shapes": lambda c: F.expr(f"approx_top_k_combine({c}, {SHAPES})")}
    return paths.groupBy("path").agg(*({**how, **sketches}.get(c, F.sum)(c).alias(c) for c in paths.columns if c != "path"))


def state_of(leaves: DataFrame, before: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The tables of a state for (seq, path, value) rows, of whole events.

    before: tables of a state that these rows will be added to: values of its wide paths aren't gathered
    again, nor those that come after ten samples it has.
    """
    filled = leaves.where("value is not null").select("path", "value")
    one = filled.withColumn("c", F.lit(1))
    values, early = filled, filled
    if before is not None:
        values = filled.join(before["paths"].where("wide").select("path"), "path", "left_anti")  # a row for each path
        full = before["samples"].groupBy("path").agg(F.count("*").alias("n"), F.max("value").alias("last")).where(F.col("n") >= FIRST)
        early = filled.join(full, "path", "left").where("last is null or value < last").select("path", "value")
    # dealt by seq first, so that neither the distinct paths nor their lists move the rows again
    events = relations.presence(leaves.repartition("seq")).groupBy("seq").agg(F.collect_list("path").alias("paths"))
    shaped = leaves.withColumn("shape", features.shape(F.col("value")))
    sketches = F.hll_sketch_agg("value", REGISTERS).alias("distinct"), F.expr(f"approx_top_k_accumulate(shape, {SHAPES})").alias("shapes")
    return {
        "paths": shaped.groupBy("path").agg(*features.sums(F.lit(1)), F.lit(False).alias("wide"), *sketches),
        "values": features.value_counts(values),
        "sizes": _summed(one.withColumn("size", F.least(F.length("value"), F.lit(1000))), ["path", "size"], "c"),
        "chars": features.char_counts(one),
        "samples": _lowest(early),
        "pairs": live.pair_counts(events, F.col("paths")).where("path_a is not null"),
        "firsts": _earliest(leaves.select("seq", "path")),
    }


def merged(a: dict[str, DataFrame], b: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The state of the rows of two states together, in any order."""
    both = {k: a[k].unionByName(b[k]) for k in TABLES}
    return {
        "paths": _merged(both["paths"]),
        "values": _summed(both["values"], ["path", "value"], "c"),
        "sizes": _summed(both["sizes"], ["path", "size"], "c"),
        "chars": _summed(both["chars"], ["path", "char"], "k"),
        "samples": _lowest(both["samples"]),
        "pairs": _summed(both["pairs"], ["path_a", "path_b"], "n"),
        "firsts": _earliest(both["firsts"]),
    }


def store(state: dict[str, DataFrame], path: str, most: int) -> None:
    """Write the tables of a state below `path`; paths with more than `most` values become wide and lose them."""
    spark = state["paths"].sparkSession
    state["values"].write.parquet(f"{path}/gathered")
    gathered = spark.read.schema(state["values"].schema).parquet(f"{path}/gathered")
    over = gathered.groupBy("path").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("path", F.lit(True).alias("_over"))
    paths = state["paths"].join(over, "path", "left")
    paths.withColumn("wide", F.col("wide") | F.coalesce("_over", F.lit(False))).drop("_over").write.parquet(f"{path}/paths")
    wide = spark.read.schema(state["paths"].schema).parquet(f"{path}/paths").where("wide").select("path")
    gathered.join(wide, "path", "left_anti").write.parquet(f"{path}/values")
    for name in TABLES[2:]:
        state[name].write.parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a stored state."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}


def feature_table(state: dict[str, DataFrame]) -> DataFrame:
    """The columns of `features.field_features`, and wide: whether unique_count and the commonest shape are estimates."""
    shapes = _summed(state["values"].withColumn("shape", features.shape(F.col("value"))), ["path", "shape"], "c").groupBy("path").agg(F.max("c").alias("_modal"))
    unique = state["values"].groupBy("path").agg(F.count("*").alias("_unique"))
    first = F.expr("get(filter(approx_top_k_estimate(shapes, 2), x -> x.item is not null), 0).count")
    filled = F.col("sample_count") - F.col("null_count")
    base = state["paths"].join(unique, "path", "left").join(shapes, "path", "left")
    base = base.withColumn("unique_count", F.when(F.col("wide"), F.least(F.hll_sketch_estimate("distinct"), filled)).otherwise(F.coalesce("_unique", F.lit(0))))
    base = base.withColumn("modal", F.when(F.col("wide"), F.least(F.coalesce(first, F.lit(1)), filled)).otherwise(F.col("_modal")))
    median = features.upper_median(state["sizes"], ["path"], "size", "c")
    samples = state["samples"].groupBy("path").agg(F.array_sort(F.collect_list("value")).alias("samples"))
    t = base.join(median, "path", "left").join(features.char_entropy(state["chars"]), "path", "left").join(samples, "path", "left")
    return features.assembled(t).join(state["paths"].select("path", "wide"), "path")


def revise(leaves: DataFrame, n_events: int, folder: str, source_id: str, batch: int | None = None, most: int = VALUES) -> dict:
    """Add events to a source's profile below `folder`: the record of the revision that holds them.

    leaves: (seq, path, value) of the new events, all of the leaves of each; n_events: their number. batch:
    a number that rises from call to call; one that isn't above the last is there already and adds
    nothing, so that a call can be repeated. The tables are written first, and the revision then
    appears in one step; where another writer was first, the rows are added to that one's revision.
    """
    spark = leaves.sparkSession
    while True:
        record = versions.latest(folder, source_id)
        if record and batch is not None and record["batch"] is not None and batch <= record["batch"]:
            return record
        before = load(spark, record["state"]) if record else None
        state = state_of(leaves, before)
        path = f"{versions.home(folder, source_id)}/states/{uuid.uuid4().hex}"
        store(state if before is None else merged(before, state), path, most)
        counters = {"state": path, "batch": record["batch"] if record and batch is None else batch, "events": n_events + (record["events"] if record else 0)}
        if record:
            counters["created_at"] = record["created_at"]
        made = versions.recorded(spark, folder, source_id, counters, record["version"] if record else 0)
        if made:
            return made


def source_profile(spark: SparkSession, record: dict, model=None) -> DataFrame:
    """The profile of a revision: one row, as `profile.source_profile` makes of all events so far."""
    state = load(spark, record["state"])
    fields = places.stored(profile.decided(feature_table(state), model).select(*profile.FIELD), "profile")  # a row for each path of a schema
    pairs = live.information(state["pairs"].unionByName(spark.createDataFrame([(None, None, record["events"])], "path_a string, path_b string, n long")))
    created = datetime.fromisoformat(record["created_at"])
    head = profile.fingerprint(state["firsts"], FIRST).select(F.lit(record["source_id"]).alias("source_id"), F.lit(record["version"]).alias("revision"), F.lit(created).alias("created_at"), "fingerprint")
    return profile.assembled(head, fields, relations.linked(pairs, fields))


def watch(events: DataFrame, leaves: Callable[[DataFrame], DataFrame], folder: str, source_id: str, checkpoint: str):
    """A writer of a stream of events whose batches each become a revision; leaves: the flattening of a batch."""

    def add(rows: DataFrame, batch: int) -> None:
        revise(leaves(rows), rows.count(), folder, source_id, batch)

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add)

"""Looking into files of typed records: shares and statistics of types and fields, sets of names, bins, bounds of peaks.

Tables are rows of (file, name, ..): a type's name in a file, with what each operator names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most different values that are told apart of a field; its first samples; bins of a histogram. Fixed values.
MOST_UNIQUE, SAMPLES, BINS = 500, 5, 20


def type_shares(records: DataFrame) -> DataFrame:
    """name, n, percent of all records, commonest first (by name where equal)."""
    counts = records.groupBy("name").agg(F.count("*").alias("n"))
    # a row for each type: the total of them is one row
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).select("name", "n", (100.0 * F.col("n") / F.col("_all")).alias("percent")).orderBy(F.desc("n"), "name")


def field_stats(values: DataFrame, keys: list[str]) -> DataFrame:
    """keys, uniques (at most MOST_UNIQUE), lo, hi and samples (the first SAMPLES values by seq); values: keys, seq and a number `value`.

    Numbers are told apart to six places. The values of a key are counted first with a map-side combine, and
    of the first ones only SAMPLES pass each task: a key of very many rows is no group of one task.
    """
    rounded = values.withColumn("_v", F.round("value", 6))
    base = rounded.groupBy(*keys, "_v").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).groupBy(*keys)
    base = base.agg(F.least(F.count("_v"), F.lit(MOST_UNIQUE)).alias("uniques"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    order = Window.partitionBy(*keys).orderBy("seq")
    first = values.where("value is not null").withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= SAMPLES)
    first = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "value"))), lambda x: x["value"]).alias("samples"))
    return base.join(first, keys, "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<double>")))


def type_matrix(records: DataFrame, files: list[str] | None = None) -> DataFrame:
    """A row for each name, a column for each file with the number of records, 0 where there are none; without `files`, of all files there are."""
    return records.groupBy("name").pivot("file", *([files] if files is not None else [])).count().na.fill(0)


def set_comparison(names: DataFrame, a, b) -> DataFrame:
    """kind (common, only_a, only_b) and name of every name in file a or file b (names: file, name), in one aggregation."""
    inside = lambda f: F.max(F.when(F.col("file") == f, 1).otherwise(0))
    found = names.where(F.col("file").isin(a, b)).groupBy("name").agg(inside(a).alias("_a"), inside(b).alias("_b"))
    return found.select(F.when(F.col("_a") + F.col("_b") == 2, "common").when(F.col("_a") == 1, "only_a").otherwise("only_b").alias("kind"), "name")


def all_names(names: DataFrame) -> DataFrame:
    """Every name of any file once, with the number of files that have it."""
    return names.select("file", "name").distinct().groupBy("name").agg(F.count("*").alias("files"))


def histogram(values: DataFrame, bins: int = BINS) -> DataFrame:
    """bin (0 to bins - 1), n of `value`, in even bins from the least to the most; the most is in the last bin, one value alone in bin 0."""
    bounds = values.agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))  # one row
    at = F.floor((F.col("value") - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins))
    bin_ = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(F.least(at, F.lit(bins - 1))).cast("long")
    return values.where("value is not null").crossJoin(F.broadcast(bounds)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


def bounds_of_peaks(peaks: DataFrame) -> DataFrame:
    """One row: ceiling (the highest peak without attack) and floor (the lowest with one); peaks: (peak, attack boolean)."""
    return peaks.agg(F.max(F.when(~F.col("attack"), F.col("peak"))).alias("ceiling"), F.min(F.when(F.col("attack"), F.col("peak"))).alias("floor"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """One row: the least threshold of a sweep with no false alarm and no miss, null if there is none."""
    return sweep.agg(F.min(F.when((F.col("fpr") == 0) & (F.col("tpr") == 1), F.col("threshold"))).alias("optimal"))


def relative_series(points: DataFrame, keys: list[str]) -> DataFrame:
    """points (keys, seq, t, ..) with seconds since the first one of their series by seq."""
    first = F.first("t").over(Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return points.withColumn("seconds", (F.col("t") - first) / 1e6)


def by_peak(results: DataFrame, files: DataFrame) -> DataFrame:
    """results (file, peak) with the columns of an inventory of the same file, lowest peak first."""
    return results.join(files, "file").orderBy("peak", "file")

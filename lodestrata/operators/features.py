"""Statistical features of the values of each path, from (path, value) rows.

Values are counted first (a map-side combine shrinks repeated ones), so every later step runs over the
distinct values of a path with their counts; no value list is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of the features, in the order in which they stand in a vector.
NAMES = [
    "mean_length", "median_length", "stddev_length", "min_length", "max_length",
    "alpha_ratio", "numeric_ratio", "hex_ratio", "punct_ratio", "whitespace_ratio", "uppercase_ratio",
    "entropy", "format_consistency",
    "dot_ratio", "dash_ratio", "colon_ratio", "slash_ratio", "underscore_ratio", "at_ratio", "mean_separator_count",
    "is_numeric_ratio", "numeric_range_span", "is_integer_ratio",
    "cardinality_ratio", "null_ratio", "length_variance_ratio", "has_fixed_length",
]
SEPARATORS = {"dot": ".", "dash": "-", "colon": ":", "slash": "/", "underscore": "_", "at": "@"}
#: What counts as a number; the same pattern is used wherever results are held against other engines.
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
CLASSES = {"alpha": r"\p{L}", "numeric": r"\p{Nd}", "hex": "[0-9a-fA-F]", "whitespace": r"\s", "uppercase": r"\p{Lu}", "plain": r"[\p{L}\p{Nd}\s]"}


def value_counts(leaves: DataFrame) -> DataFrame:
    return leaves.groupBy("path", "value").agg(F.count("*").alias("c"))


def shape(column) -> Column:
    """Letters to A, then digits to N: the other way round the N of a digit would become A."""
    return F.regexp_replace(F.regexp_replace(column, r"\p{L}", "A"), r"\p{Nd}", "N")


def upper_median(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """keys and `median`: element n // 2 of the sorted values, each repeated `weight` times."""
    counts = rows.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    part = Window.partitionBy(*keys)
    ranked = counts.withColumn("_up", F.sum("_w").over(part.orderBy(value))).withColumn("_n", F.sum("_w").over(part))
    return ranked.where("_up > floor(_n / 2)").groupBy(*keys).agg(F.min(value).alias("median"))


def char_counts(counts: DataFrame) -> DataFrame:
    """path, char, k: how often each character is in a path's values (path, value, c)."""
    return counts.select("path", "c", F.explode(F.split("value", "")).alias("char")).where("char <> ''").groupBy("path", "char").agg(F.sum("c").alias("k"))


def char_entropy(chars: DataFrame) -> DataFrame:
    """path, entropy in bits of its characters (path, char, k)."""
    total = chars.groupBy("path").agg(F.sum("k").alias("t"))
    return chars.join(total, "path").groupBy("path").agg(F.sum(-(F.col("k") / F.col("t")) * F.log2(F.col("k") / F.col("t"))).alias("entropy"))


def sums(c: Column) -> list[Column]:
    """What adds up over the values of a path, each counted c times; sums, and the least and largest, of parts are those of the whole."""
    size, number = F.length("value"), F.col("value").rlike(NUMBER)
    weigh = lambda column: F.coalesce(F.sum(c * column), F.lit(0))
    share = lambda condition: weigh(F.when(condition, 1).otherwise(0))
    return [
        F.sum(c).alias("sample_count"),
        share(F.col("value").isNull()).alias("null_count"),
        weigh(size).alias("chars"),
        weigh(size.cast("long") * size).alias("squares"),
        F.min(size).alias("lo"),
        F.max(size).alias("hi"),
        *(weigh(F.regexp_count("value", F.lit(p))).alias(f"k_{k}") for k, p in CLASSES.items()),
        *(share(F.contains("value", F.lit(s))).alias(f"h_{k}") for k, s in SEPARATORS.items()),
        weigh(F.regexp_count("value", F.lit(r"[.\-:/_@]"))).alias("separators"),
        share(number).alias("numbers"),
        share(number & F.col("value").rlike("^-*[0-9]+$")).alias("integers"),
        F.max(F.when(number, F.col("value").try_cast("double"))).alias("top"),
        F.min(F.when(number, F.col("value").try_cast("double"))).alias("bottom"),
    ]


def field_features(leaves: DataFrame) -> DataFrame:
    """path, sample_count, null_count, unique_count, samples (the first ten distinct values in order) and the features.

    A path without values that aren't null has zeros throughout and no samples. Lengths are capped at
    1000 characters, entropy at 7 bits, spans at 100000, separators at 10, each as a share of the cap.
    """
    counts = value_counts(leaves)
    filled = counts.where("value is not null")
    base = counts.groupBy("path").agg(F.count("value").alias("unique_count"), *sums(F.col("c")))
    modal = filled.groupBy("path", shape("value").alias("shape")).agg(F.sum("c").alias("k")).groupBy("path").agg(F.max("k").alias("modal"))
    median = upper_median(filled.withColumn("size", F.length("value")), ["path"], "size", "c")
    firsts = filled.withColumn("_r", F.row_number().over(Window.partitionBy("path").orderBy("value"))).where("_r <= 10").groupBy("path").agg(F.array_sort(F.collect_list("value")).alias("samples"))
    t = base.join(modal, "path", "left").join(median, "path", "left").join(char_entropy(char_counts(filled)), "path", "left").join(firsts, "path", "left")
    return assembled(t)


def consistency(leaves: DataFrame) -> DataFrame:
    """path, unique_count and format_consistency alone, as `field_features` gives them: one count of values, which are read once."""
    counts = value_counts(leaves).where("value is not null").groupBy("path", shape("value").alias("shape")).agg(F.count("*").alias("u"), F.sum("c").alias("k"))
    found = counts.groupBy("path").agg(F.sum("u").alias("unique_count"), (F.max("k") / F.sum("k")).alias("format_consistency"))
    none = leaves.groupBy("path").agg(F.lit(0).alias("_"))
    return none.join(found, "path", "left").select("path", F.coalesce("unique_count", F.lit(0)).alias("unique_count"), F.coalesce("format_consistency", F.lit(0.0)).alias("format_consistency"))


def assembled(t: DataFrame) -> DataFrame:
    """The features, from path, unique_count, the `sums` of its values, modal, median, entropy and samples."""
    n = F.col("sample_count") - F.col("null_count")
    some = F.greatest(n, F.lit(1)).cast("double")
    chars = F.greatest("chars", F.lit(1)).cast("double")
    cap = lambda column, most: F.least(F.coalesce(column, F.lit(0)) / most, F.lit(1.0))
    mean = F.col("chars") / some
    variance = F.greatest(F.col("squares") / some - mean * mean, F.lit(0.0))
    features = {
        "mean_length": cap(mean, 1000.0), "median_length": cap(F.col("median"), 1000.0), "stddev_length": cap(F.sqrt(variance), 1000.0),
        "min_length": cap(F.col("lo"), 1000.0), "max_length": cap(F.col("hi"), 1000.0),
        **{f"{k}_ratio": F.col(f"k_{k}") / chars for k in ("alpha", "numeric", "hex", "whitespace", "uppercase")},
        "punct_ratio": (F.col("chars") - F.col("k_plain")) / chars,
        "entropy": cap(F.col("entropy"), 7.0), "format_consistency": F.col("modal") / some,
        **{f"{k}_ratio": F.col(f"h_{k}") / some for k in SEPARATORS},
        "mean_separator_count": cap(F.col("separators") / (6.0 * some), 10.0),
        "is_numeric_ratio": F.col("numbers") / some, "numeric_range_span": cap(F.col("top") - F.col("bottom"), 100000.0), "is_integer_ratio": F.col("integers") / some,
        "cardinality_ratio": F.col("unique_count") / some, "null_ratio": F.col("null_count") / F.col("sample_count"),
        "length_variance_ratio": F.least(variance / (mean * mean + 1e-10), F.lit(1.0)),
        "has_fixed_length": F.when((F.col("lo") == F.col("hi")) & (n > 1), 1.0).otherwise(0.0),
    }
    cells = [F.when(n > 0, F.coalesce(features[k].cast("double"), F.lit(0.0))).otherwise(F.lit(0.0)).alias(k) for k in NAMES]
    return t.select("path", "sample_count", "null_count", "unique_count", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"), *cells)


def vector(table: DataFrame) -> DataFrame:
    """The features as one array column."""
    return table.withColumn("feature_vector", F.array(*NAMES))

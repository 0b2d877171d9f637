"""Fields that come together: mutual information of their presence, and labelled edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Label of a pair of hints, in either order; any other pair is CO_OCCURS_WITH. Fixed values.
PAIR_LABELS = [
    ("ipv4", "ipv4", "COMMUNICATES_WITH"), ("ipv6", "ipv6", "COMMUNICATES_WITH"), ("ipv4", "ipv6", "COMMUNICATES_WITH"),
    ("ipv4", "fqdn", "RESOLVES_TO"), ("ipv6", "fqdn", "RESOLVES_TO"),
    ("hash_md5", "fqdn", "OBSERVED_ON"), ("hash_sha1", "fqdn", "OBSERVED_ON"), ("hash_sha256", "fqdn", "OBSERVED_ON"), ("hash", "fqdn", "OBSERVED_ON"),
    ("ipv4", "url", "HOSTS"), ("ipv6", "url", "HOSTS"),
]


def mutual_information(both: Column, a: Column, b: Column, n: Column) -> Column:
    """Bits that the presence of one field tells of the other's, from the numbers of events with both, each, and all."""

    def term(joint, x, y):
        return F.when((joint > 0) & (x > 0) & (y > 0), joint / n * F.log2(joint.cast("double") * n / (x.cast("double") * y))).otherwise(0.0)

    total = term(both, a, b) + term(a - both, a, n - b) + term(b - both, n - a, b) + term(n - a - b + both, n - a, n - b)
    return F.when(n > 0, F.greatest(total, F.lit(0.0))).otherwise(0.0)


def presence(leaves: DataFrame) -> DataFrame:
    """(seq, path) of values that are neither null nor blank."""
    return leaves.where("value is not null and trim(value) <> ''").select("seq", "path").distinct()


def co_occurrence(leaves: DataFrame, n_events: int) -> DataFrame:
    """path_a < path_b, both_count, mutual_information of all pairs of paths that come together.

    Pairs are made within an event, whose paths are bounded by its own width, and counted with a
    map-side combine; pairs that never meet have no row.
    """
    seen = presence(leaves)
    single = seen.groupBy("path").agg(F.count("*").alias("k"))
    sets = seen.groupBy("seq").agg(F.array_sort(F.collect_list("path")).alias("p"))
    pairs = sets.select("p", F.posexplode("p").alias("i", "path_a")).select("path_a", F.explode(F.expr("slice(p, i + 2, size(p))")).alias("path_b"))
    both = pairs.groupBy("path_a", "path_b").agg(F.count("*").alias("both_count"))
    out = both.join(single.select(F.col("path").alias("path_a"), F.col("k").alias("ka")), "path_a").join(single.select(F.col("path").alias("path_b"), F.col("k").alias("kb")), "path_b")
    mi = mutual_information(F.col("both_count"), F.col("ka"), F.col("kb"), F.lit(n_events))
    return out.select("path_a", "path_b", "both_count", mi.alias("mutual_information"))


def labelled(pairs: DataFrame, hint_a: str, hint_b: str) -> DataFrame:
    """pairs with relationship_type, looked up by the two hints in either order."""
    spark = pairs.sparkSession
    table = spark.createDataFrame([(*sorted((a, b)), label) for a, b, label in PAIR_LABELS], "x string, y string, relationship_type string")
    found = pairs.withColumn("_x", F.least(hint_a, hint_b)).withColumn("_y", F.greatest(hint_a, hint_b)).join(F.broadcast(table), (F.col(hint_a).isNotNull() & F.col(hint_b).isNotNull()) & (F.col("_x") == F.col("x")) & (F.col("_y") == F.col("y")), "left")
    return found.withColumn("relationship_type", F.coalesce("relationship_type", F.lit("CO_OCCURS_WITH"))).drop("_x", "_y", "x", "y")


def edges(leaves: DataFrame, fields: DataFrame, n_events: int, threshold: float = 0.1) -> DataFrame:
    """Edges between entity fields whose unrounded mutual information is at least the threshold; strongest first.

    fields: path, role, type_hint (of all fields; those with the role entity count).
    """
    kept = fields.where("role = 'entity'").select("path")
    return linked(co_occurrence(leaves.join(kept, "path", "left_semi"), n_events), fields, threshold)


def linked(pairs: DataFrame, fields: DataFrame, threshold: float = 0.1) -> DataFrame:
    """As `edges`, from the pairs of a `co_occurrence` of all paths."""
    kept = fields.where("role = 'entity'").select("path", "type_hint")
    pairs = pairs.where(F.col("mutual_information") >= threshold).join(kept.select(F.col("path").alias("path_a"), F.col("type_hint").alias("hint_a")), "path_a").join(kept.select(F.col("path").alias("path_b"), F.col("type_hint").alias("hint_b")), "path_b")
    return labelled(pairs, "hint_a", "hint_b").withColumn("mutual_information", F.round("mutual_information", 4)).orderBy(F.desc("mutual_information"), "path_a", "path_b")

"""Roles and format hints of fields, from their features and sample values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of formats. Fixed values.
IPV4 = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"
IPV6 = r"^([0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}$"
MAC = r"^([0-9a-fA-F]{2}[:\-]){5}[0-9a-fA-F]{2}$"
HEX = r"^[0-9a-fA-F]{32}$|^[0-9a-fA-F]{40}$|^[0-9a-fA-F]{64}$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
URL = r"^https?://"
FQDN = r"^[a-zA-Z][a-zA-Z0-9\-]*(\.[a-zA-Z][a-zA-Z0-9\-]*)+$"
ISO_TIME = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"
#: An IPv4 address whose parts are at most 255.
OCTETS = r"^0*(25[0-5]|2[0-4]\d|1?\d?\d)(\.0*(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"


def share(samples: Column, test) -> Column:
    return F.size(F.filter(samples, test)) / F.greatest(F.size(samples), F.lit(1)).cast("double")


def type_hint(samples: Column) -> Column:
    """ipv4, ipv6, mac, hash_md5, hash_sha1, hash_sha256, uuid, url, fqdn or null; the first whose share is over its bound."""
    like = lambda pattern: share(samples, lambda x: x.rlike(pattern))
    digits = lambda n: F.size(F.filter(samples, lambda x: x.rlike(HEX) & (F.length(x) == n)))
    lengths = {"hash_md5": digits(32), "hash_sha1": digits(40), "hash_sha256": digits(64)}
    most = F.greatest(*lengths.values())
    digest = F.when(lengths["hash_md5"] == most, "hash_md5").when(lengths["hash_sha1"] == most, "hash_sha1").otherwise("hash_sha256")
    return (
        F.when((like(IPV4) > 0.8) & (share(samples, lambda x: x.rlike(IPV4) & x.rlike(OCTETS)) > 0.8), "ipv4")
        .when(like(IPV6) > 0.6, "ipv6").when(like(MAC) > 0.6, "mac").when(like(HEX) > 0.7, digest)
        .when(like(UUID) > 0.6, "uuid").when(like(URL) > 0.5, "url").when(like(FQDN) > 0.5, "fqdn")
    )


def entity_score() -> Column:
    """Evidence, up to about 1.15, that a field identifies something. Bounds and points are fixed values."""
    filled = F.col("sample_count") - F.col("null_count")
    card = F.col("unique_count") / F.greatest(filled, F.lit(1)).cast("double")
    add = lambda condition, points: F.when(condition, F.lit(points)).otherwise(F.lit(0.0))
    length = F.col("mean_length") * 1000
    marks = F.col("dot_ratio") + F.col("dash_ratio") + F.col("colon_ratio") + F.col("underscore_ratio") + F.col("at_ratio")
    score = F.when((card > 0.1) & (card < 0.95), 0.3).when((card >= 0.95) & (F.col("unique_count") > 5), 0.2).otherwise(0.0)
    for term in (
        add(marks > 0.3, 0.2), add(F.col("length_variance_ratio") < 0.3, 0.15), add(F.col("has_fixed_length") > 0.5, 0.2), add((length > 5) & (length < 100), 0.15),
        add((F.col("alpha_ratio") > 0.2) & (F.col("numeric_ratio") > 0.1), 0.1), add(F.col("entropy") > 0.4, 0.1),
    ):
        score = score + term
    return score


def classified(features: DataFrame) -> DataFrame:
    """features with role (temporal, metric, enum, text, entity, unknown), is_entity and, for entities, type_hint. Bounds are fixed values."""
    filled = F.col("sample_count") - F.col("null_count")
    card = F.col("unique_count") / F.greatest(filled, F.lit(1)).cast("double")
    length = F.col("mean_length") * 1000
    times = (F.col("colon_ratio") > 0.8) & (F.col("dash_ratio") > 0.5) & (length > 15) & (length < 35) & (share(F.col("samples"), lambda x: x.rlike(ISO_TIME)) > 0.7)
    role = (
        F.when(filled == 0, "unknown").when(times, "temporal").when(F.col("is_numeric_ratio") > 0.9, "metric")
        .when((F.col("unique_count") <= 3) & (filled >= 5) | (card < 0.1) & (filled >= 10), "enum")
        .when((length > 50) & (F.col("alpha_ratio") > 0.7) & (F.col("whitespace_ratio") > 0.05), "text")
        .when(entity_score() >= 0.5, "entity").otherwise("unknown")
    )
    out = features.withColumn("role", role).withColumn("is_entity", F.col("role") == "entity")
    return out.withColumn("type_hint", F.when(F.col("is_entity"), type_hint(F.col("samples"))))

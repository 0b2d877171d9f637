"""The source profile: fields with roles and hints, edges, a structural fingerprint and a revision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import features, learning, relations, roles
from lodestrata.sources import places


#: Columns of a field, and of a relationship, in a profile.
FIELD = ["path", "role", "type_hint", "is_entity", "confidence", "cluster_id", "sample_count", "null_count", "unique_count", "profile_cardinality", "samples"]
RELATIONSHIP = ["mutual_information", "path_a", "path_b", "both_count", "relationship_type"]
SCHEMA = (
    "source_id string, revision int, created_at timestamp, fingerprint string, "
    "fields array<struct<path:string,role:string,type_hint:string,is_entity:boolean,confidence:double,cluster_id:int,sample_count:bigint,null_count:bigint,unique_count:bigint,profile_cardinality:double,samples:array<string>>>, "
    "relationships array<struct<mutual_information:double,path_a:string,path_b:string,both_count:bigint,relationship_type:string>>"
)


def quoted(text):
    """Text as a JSON string: quotes, backslashes and control characters escaped."""
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def fingerprint(leaves: DataFrame, first: int = 10) -> DataFrame:
    """One row: the first 16 hexadecimal digits of the sha256 of the sorted distinct paths of the `first` events, as a JSON array."""
    seqs = leaves.select("seq").distinct().orderBy("seq").limit(first)
    paths = leaves.join(seqs, "seq", "left_semi").agg(F.array_sort(F.collect_set("path")).alias("p"))
    listed = F.concat(F.lit("["), F.array_join(F.transform("p", quoted), ", "), F.lit("]"))
    return paths.select(F.substring(F.sha2(listed, 256), 1, 16).alias("fingerprint"))


def field_profiles(leaves: DataFrame, model=None, found: DataFrame | None = None) -> DataFrame:
    """A row for each path: features, the role, hint, confidence and cluster that count, and the share of distinct values among all samples.

    model: of `learning.train`, roles go by rule without it; found: of `learning.clusters`, of these fields if None.
    """
    return decided(features.field_features(leaves), model, found)


def decided(table: DataFrame, model=None, found: DataFrame | None = None) -> DataFrame:
    """As `field_profiles`, from the features of the fields."""
    table = places.stored(features.vector(roles.classified(table)), "fields")  # a row for each path of a schema
    found = learning.clusters(table.select("path", "feature_vector")) if found is None else found
    predicted = learning.predict(model, table.select("path", "feature_vector")) if model is not None else None
    return learning.decided(table, predicted, found).withColumn("profile_cardinality", F.col("unique_count") / F.col("sample_count"))


def source_profile(leaves: DataFrame, n_events: int, source_id: str, previous: DataFrame | None = None, model=None) -> DataFrame:
    """One row of SCHEMA. No events: empty arrays.

    previous: the profile before this one, whose revision is one less and whose created_at is kept.
    """
    fields = places.stored(field_profiles(leaves, model).select(*FIELD), "profile")  # a row for each path of a schema
    before = previous.select("revision", "created_at").first() if previous is not None else None
    revision, created = (before.revision + 1, F.lit(before.created_at)) if before else (1, F.current_timestamp())
    head = fingerprint(leaves).select(F.lit(source_id).alias("source_id"), F.lit(revision).alias("revision"), created.cast("timestamp").alias("created_at"), "fingerprint")
    return assembled(head, fields, relations.edges(leaves, fields, n_events))


def assembled(head: DataFrame, fields: DataFrame, links: DataFrame) -> DataFrame:
    """One row of SCHEMA from its first columns (one row), the fields and the relationships."""
    listed = fields.agg(F.sort_array(F.collect_list(F.struct(*FIELD))).alias("fields"))
    links = links.agg(F.sort_array(F.collect_list(F.struct(*RELATIONSHIP)), asc=False).alias("relationships"))
    return head.crossJoin(listed).crossJoin(links).to(head.sparkSession.createDataFrame([], SCHEMA).schema)  # one row each


def to_json(profiles: DataFrame) -> DataFrame:
    """source_id, and each profile as a JSON text."""
    return profiles.select("source_id", F.to_json(F.struct(*profiles.columns), {"ignoreNullFields": "false"}).alias("json"))


def from_json(texts: DataFrame) -> DataFrame:
    """Profiles out of JSON texts (json)."""
    return texts.select(F.from_json("json", SCHEMA).alias("p")).select("p.*")


def fields_of(profiles: DataFrame, role: str | None = None, hint: str | None = None, path: str | None = None) -> DataFrame:
    """source_id and the columns of each field, of one role, hint or path where given."""
    out = profiles.select("source_id", F.explode("fields").alias("f")).select("source_id", "f.*")
    for column, wanted in (("role", role), ("type_hint", hint), ("path", path)):
        if wanted is not None:
            out = out.where(F.col(column) == wanted)
    return out


def relationships_of(profiles: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """source_id and the columns of each relationship, of the pair of paths (in either order) where given."""
    out = profiles.select("source_id", F.explode("relationships").alias("r")).select("source_id", "r.*")
    if a is not None and b is not None:
        out = out.where((F.col("path_a") == min(a, b)) & (F.col("path_b") == max(a, b)))
    return out


#: Order of roles in a listing.
ROLE_ORDER = ["entity", "metric", "enum", "temporal", "text", "unknown"]


def role_counts(profiles: DataFrame) -> DataFrame:
    """source_id, role, n: fields by role, and the entities' number among them."""
    return fields_of(profiles).groupBy("source_id", "role").agg(F.count("*").alias("n"))


def listing(profiles: DataFrame) -> DataFrame:
    """Fields in order of their roles, by path within one."""
    rank = F.array_position(F.array(*map(F.lit, ROLE_ORDER)), F.col("role"))
    return fields_of(profiles).orderBy("source_id", rank, "path")

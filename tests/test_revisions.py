"""Profiles that grow from revision to revision, against one made of all events at once."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import features, versions
from lodestrata.plans import profile, revisions
from lodestrata.streaming import live

EXACT = [c for c in features.NAMES if c not in ("cardinality_ratio", "format_consistency")]
SCHEMA = "seq long, path string, value string"


def events(n: int, seed: int = 3) -> list[tuple]:
    rng, rows = random.Random(seed), []
    for seq in range(n):
        pair = rng.random() < 0.5
        rows += [(seq, "wide", f"{'x' * rng.randrange(1, 4)}-{rng.randrange(10**9)}"), (seq, "kind", rng.choice("abc")), (seq, "long", "y" * rng.choice([1, 999, 1000, 1700]))]
        rows += [(seq, "src", f"10.0.{rng.randrange(30)}.{rng.randrange(250)}"), (seq, "dst", f"10.1.0.{rng.randrange(250)}")] if pair else []
        rows += [(seq, "some", rng.choice([None, "", " ", "1.5", "-2"])), (seq, "none", None)]
        rows += [(seq, "late", str(seq))] if seq > 0.8 * n else []
    return rows


def check(spark, record, leaves, n, most):
    whole = {r.path: r for r in features.field_features(leaves).collect()}
    found = {r.path: r for r in revisions.feature_table(revisions.load(spark, record["state"])).collect()}
    assert found.keys() == whole.keys() and record["events"] == n
    for path, want in whole.items():
        have = found[path]
        assert have.wide == (want.unique_count > most), path
        assert (have.sample_count, have.null_count, have.samples) == (want.sample_count, want.null_count, want.samples), path
        assert all(math.isclose(have[c], want[c], rel_tol=1e-9, abs_tol=1e-12) for c in EXACT), path
        if have.wide:
            assert abs(have.unique_count - want.unique_count) <= 0.08 * want.unique_count
            assert abs(have.format_consistency - want.format_consistency) <= revisions.ERROR
        else:
            assert (have.unique_count, have.format_consistency) == (want.unique_count, want.format_consistency)


@pytest.mark.parametrize("cuts", [[0, 600], [0, 0, 250, 600]])
def test_any_split_gives_the_whole(spark, tmp_path, cuts):
    leaves = spark.createDataFrame(events(600), SCHEMA)
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        record = revisions.revise(leaves.where((F.col("seq") >= a) & (F.col("seq") < b)), b - a, str(tmp_path), "s", i, most=200)
    assert record["version"] == len(cuts) - 1
    check(spark, record, leaves, 600, 200)
    got, want = revisions.source_profile(spark, record).first(), profile.source_profile(leaves, 600, "s").first()
    assert (got.source_id, got.revision, got.fingerprint) == ("s", len(cuts) - 1, want.fingerprint)
    assert {(f.path, f.role, f.type_hint) for f in got.fields} == {(f.path, f.role, f.type_hint) for f in want.fields}
    assert got.relationships == want.relationships and {(r.path_a, r.path_b, r.relationship_type) for r in got.relationships} == {("dst", "src", "COMMUNICATES_WITH")}


def test_samples_come_first_whatever_the_order_of_batches(spark, tmp_path):
    leaves = spark.createDataFrame([(i, "p", f"{i:03d}") for i in range(100)], SCHEMA)
    for i, (a, b) in enumerate([(50, 100), (20, 50), (0, 20)]):
        record = revisions.revise(leaves.where((F.col("seq") >= a) & (F.col("seq") < b)), b - a, str(tmp_path), "s", i, most=10)
    check(spark, record, leaves, 100, 10)
    assert revisions.load(spark, record["state"])["values"].count() == 0  # the path is wide from its first batch on
    assert [r.seq for r in revisions.load(spark, record["state"])["firsts"].orderBy("seq").collect()] == list(range(10))


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    leaves = spark.createDataFrame(events(40), SCHEMA)
    first = revisions.revise(leaves, 40, str(tmp_path), "s", 0)
    assert revisions.revise(leaves, 40, str(tmp_path), "s", 0) == first
    second = revisions.revise(leaves.withColumn("seq", F.col("seq") + 40), 40, str(tmp_path), "s")  # without a number, it is always added
    assert (second["version"], second["events"], second["batch"], second["created_at"]) == (2, 80, 0, first["created_at"])
    assert versions.latest(str(tmp_path), "other") is None


def test_the_writer_that_comes_second_adds_to_the_first(spark, tmp_path, monkeypatch):
    leaves = spark.createDataFrame(events(60), SCHEMA)
    part = lambda a, b: leaves.where((F.col("seq") >= a) & (F.col("seq") < b))
    store, once = revisions.store, []

    def slow(state, path, most):
        store(state, path, most)
        if not once:
            once.append(1)
            revisions.revise(part(30, 60), 30, str(tmp_path), "s", most=20)

    monkeypatch.setattr(revisions, "store", slow)
    record = revisions.revise(part(0, 30), 30, str(tmp_path), "s", most=20)
    assert record["version"] == 2
    check(spark, record, leaves, 60, 20)


def test_values_of_a_thousand_shapes(spark, tmp_path):
    digests = spark.range(6000).selectExpr("id seq", "'digest' path", "md5(cast(id as string)) value")
    record = revisions.revise(digests, 6000, str(tmp_path), "s", most=100)
    check(spark, record, digests, 6000, 100)


def test_no_events(spark, tmp_path):
    record = revisions.revise(spark.createDataFrame([], SCHEMA), 0, str(tmp_path), "s")
    p = revisions.source_profile(spark, record).first()
    assert (p.revision, p.fields, p.relationships) == (1, [], [])
    leaves = spark.createDataFrame(events(30), SCHEMA)
    check(spark, revisions.revise(leaves, 30, str(tmp_path), "s", most=5), leaves, 30, 5)


def test_batches_of_a_stream(spark, tmp_path):
    rows = spark.range(90).select("id", (F.col("id") % 7).cast("string").alias("a"), F.concat(F.lit("h"), "id").alias("b"))
    rows.repartition(3, "id").write.parquet(f"{tmp_path}/in")
    flat = lambda df: df.selectExpr("id seq", "stack(2, 'a', a, 'b', b) as (path, value)")
    for _ in range(2):  # begun again, it finds nothing new
        stream = live.tail(spark, f"{tmp_path}/in", rows.schema, files=1)
        revisions.watch(stream, flat, f"{tmp_path}/out", "s", f"{tmp_path}/place").trigger(availableNow=True).start().awaitTermination()
    record = versions.latest(f"{tmp_path}/out", "s")
    assert record["version"] == 3
    check(spark, record, flat(rows), 90, revisions.VALUES)


def test_features_without_numbers_or_characters(spark):
    found = {r.path: r for r in features.field_features(spark.createDataFrame([("words", "abc"), ("empty", "")], "path string, value string")).collect()}
    assert found["words"].numeric_range_span == 0 and found["empty"].numeric_range_span == 0 and found["empty"].entropy == 0


def test_three_batches_whatever_their_rows(spark, tmp_path):
    from lodestrata import catalogue

    spark.createDataFrame([(1, 1, "click", 2.5)], "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert catalogue.network_revision(spark, str(tmp_path))["version"] == 3


def test_consistency_is_that_of_all_features(spark):
    from lodestrata.operators import features

    rows = [(i, p, v) for i in range(60) for p, v in (("a", f"x{i % 7}"), ("b", None if i % 3 else str(i)), ("none", None), ("c", ["é1", "12", "q"][i % 3]))]
    leaves = spark.createDataFrame(rows, "seq long, path string, value string")
    columns = ["path", "unique_count", "format_consistency"]
    assert sorted(map(tuple, features.consistency(leaves).select(columns).collect())) == sorted(map(tuple, features.field_features(leaves).select(columns).collect()))

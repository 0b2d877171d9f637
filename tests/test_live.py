import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import relations, telemetry
from lodestrata.streaming import live


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    yield
    spark.conf.unset(key)


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_out_of_order_count_as_in_order(spark, tmp_path, rocks, seed):
    rng = random.Random(seed)
    rows = [(f, i, rng.randrange(5), i) for f in range(12) for i in range(rng.randrange(1, 120))]
    schema = "file long, seq long, status long, at long"
    late, arrived = 30, sorted(rows, key=lambda r: r[3] + rng.random() * 25)  # never more than `late` behind
    cuts = [0, len(rows) // 3, len(rows) // 2, len(rows)]
    for k, part in enumerate([*(arrived[a:b] for a, b in zip(cuts, cuts[1:])), [(99, 0, 0, 10**6)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    points = live.tail(spark, f"{tmp_path}/in/*", spark.createDataFrame([], schema).schema, files=1).withColumn("at", F.timestamp_seconds(F.col("at") + 1_000))
    out = live.glitches_in_order(points, "at", f"{late} seconds")
    for _ in range(2):
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(300)
    got = {r.file: r.n for r in spark.read.parquet(f"{tmp_path}/out").groupBy("file").agg(F.max("glitches").alias("n")).collect()}
    want = {r.file: r.glitches for r in telemetry.gps_glitches(spark.createDataFrame(rows, schema)).collect()}
    assert {f: got[f] for f in range(12)} == {f: want.get(f, 0) for f in range(12)} and sum(want.values()) > 20


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_of_a_stream_are_those_of_all_events(spark, tmp_path, seed):
    rng = random.Random(seed)
    events = [(i, [p for p in "abcde" if rng.random() < 0.4] * rng.choice([1, 2]) or rng.choice([None, [None], []])) for i in range(200)]
    schema = "seq long, paths array<string>"
    at = 0
    while at < len(events):
        k = rng.randrange(1, 90)
        spark.createDataFrame(events[at : at + k], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{at}")
        at += k
    df = spark.createDataFrame(events, schema)
    seen = []
    stream = live.tail(spark, f"{tmp_path}/in/*", df.schema, files=1)
    live.watch_pairs(stream, F.col("paths"), lambda t, b: seen.append(sorted(map(tuple, t.collect()))), f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(300)
    leaves = df.select("seq", F.explode("paths").alias("path")).where("path is not null").withColumn("value", F.lit("x"))
    want = sorted(map(tuple, relations.co_occurrence(leaves, len(events)).collect()))
    assert len(seen) > 2 and [r[:3] for r in seen[-1]] == [r[:3] for r in want] and all(a[3] == pytest.approx(b[3], abs=1e-12) for a, b in zip(seen[-1], want))
    assert sorted(map(tuple, live.information(live.pair_counts(df, F.col("paths"))).collect())) == seen[-1]
    assert live.information(live.pair_counts(df.limit(0), F.col("paths"))).count() == 0


def test_state_of_a_file_is_read_and_written_once(monkeypatch):
    from types import SimpleNamespace

    calls, kept = [], []

    class Value:
        def get(self):
            calls.append("get")
            return kept[-1] if kept else None

        def update(self, value):
            calls.append("update")
            kept.append(value)

    handle = SimpleNamespace(getValueState=lambda *a: Value(), registerTimer=lambda t: calls.append("timer"))
    at = lambda w: SimpleNamespace(getCurrentWatermarkInMs=lambda: w)
    step = live.InOrder()
    step.init(handle)
    rows = [SimpleNamespace(seq=i, at=i, status=3 * (i % 2)) for i in range(1000)]
    assert [r.glitches for r in step.handleInputRows((1,), rows[::-1], at(499))] == [249] and calls == ["timer", "get", "update"]
    assert [r.glitches for r in step.handleExpiredTimer((1,), at(999), None)] == [499] and len(calls) == 5
    assert list(step.handleExpiredTimer((1,), at(2000), None)) == [] and kept[-1][4:] == ([], [], [])

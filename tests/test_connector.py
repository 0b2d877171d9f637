import io
import json
import time

import pytest
from pyspark.sql import functions as F

from lodestrata.sources import connector, places


@pytest.mark.parametrize("text", [b"", b"\n", b"a", b"a\n", b"\n\na\n", b"ab\ncde\n\nf", b"x" * 50 + b"\ny\n" + b"z" * 9])
def test_lines_of_all_cuts(text):
    want = []
    at = 0
    for line in text.split(b"\n"):
        want.append((at, line))
        at += len(line) + 1
    if want[-1][1] == b"":
        want.pop()
    for step in (1, 2, 3, 7, 100):
        for block in (1, 2, 5, 64):
            got = [x for s in range(0, len(text), step) for x in places.lines(io.BytesIO(text), s, min(s + step, len(text)), block)]
            assert got == want, (step, block)


def test_ranges():
    files = [("a", 0, 25), ("b", 0, 3), ("c", 0, 4), ("d", 5, 5)]
    got = places.ranges(files, 10)
    assert got == [[("a", 0, 10)], [("a", 10, 20)], [("a", 20, 25), ("b", 0, 3)], [("c", 0, 4)]]


def read(spark, path, **options):
    connector.register(spark)
    return spark.read.format(connector.NAME).options(path=str(path), **options).load()


def test_batch(spark, tmp_path):
    (tmp_path / "day=1").mkdir()
    (tmp_path / "day=1" / "b.jsonl").write_text('{"a": 1}\n\n{}\nbroken\n[1]\n{"a": "é", "_id": "mine"}')
    (tmp_path / "a.jsonl").write_bytes(b'{"a": 1e5}\r\n\xff\xfe{}\n')
    (tmp_path / "_hidden.jsonl").write_text('{"a": 9}\n')
    (tmp_path / "c.txt").write_text('{"a": 9}\n')
    (tmp_path / "empty.jsonl").write_text("")
    for split in (3, 1000):
        rows = read(spark, tmp_path, pattern="*.jsonl", source_id="s", inject="true", split_bytes=str(split)).orderBy("index", "at").collect()
        assert [(r["index"], r.at, r.error) for r in rows] == [("a.jsonl", 0, None), ("a.jsonl", 12, "no JSON"), ("day=1/b.jsonl", 0, None), ("day=1/b.jsonl", 10, None), ("day=1/b.jsonl", 13, "no JSON"), ("day=1/b.jsonl", 20, "no JSON object"), ("day=1/b.jsonl", 24, None)]
        assert rows[0].payload == '{"a": 1e5, "_index": "a.jsonl", "_id": "a.jsonl:0"}'  # numbers keep their form
        assert json.loads(rows[3].payload) == {"_index": "day=1/b.jsonl", "_id": "day=1/b.jsonl:10"}
        assert json.loads(rows[6].payload) == {"a": "é", "_index": "day=1/b.jsonl", "_id": "day=1/b.jsonl:24"}
        assert rows[0].source_id == "s" and rows[0].received_at is not None
    plain = read(spark, tmp_path, pattern="*.jsonl")
    assert [(r.seq, r.payload) for r in connector.sample(plain, 2).collect()] == [(0, '{"a": 1e5}'), (1, '{"a": 1}')] and connector.sample(plain).count() == 4
    seen = connector.delivered(plain, lambda df: df.write.format("noop").mode("overwrite").save())
    assert (seen["delivered"], seen["errors"]) == (4, 3) and seen["last_event_at"]
    (tmp_path / "nothing").mkdir()
    assert read(spark, tmp_path / "nothing").count() == 0
    assert connector.connect({"path": str(tmp_path)}) == ("connected", "") and connector.connect({"path": str(tmp_path / "gone")})[0] == "failed" and connector.connect({})[0] == "failed"


def test_many_tasks_and_chosen_files(spark, tmp_path):
    for name in "ab":
        (tmp_path / name).write_text("".join(f'{{"n": "{name}{i}"}}\n' for i in range(5_000)))
    df = read(spark, tmp_path, split_bytes="9000")
    assert df.rdd.getNumPartitions() > 10 and df.select("id").distinct().count() == df.count() == 10_000
    one = df.where("index = 'b' and index in ('a', 'b')")
    assert one.count() == 5_000 and one.rdd.getNumPartitions() < 12
    assert df.where("index = 'a' and index = 'b'").count() == 0 and df.where("index is not null and payload like '%a77\"%'").count() == 1


def collected(spark, path):
    return sorted(r.n for r in spark.read.json(str(path)).select(F.get_json_object("payload", "$.n").cast("int").alias("n")).collect())


def test_stream_goes_on_where_it_was_stopped(spark, tmp_path):
    """Lines come once, whatever is added while the query is down, fails or reads; half a line waits for its end."""
    connector.register(spark)
    source, sink, place = tmp_path / "in", tmp_path / "out", tmp_path / "place"
    source.mkdir()
    n = 0

    def add(name, k, end="\n"):
        nonlocal n
        with open(source / name, "a") as f:
            f.write("".join(f'{{"n": {n + i}}}\n' for i in range(k))[: -1 if k else None] + end)
        n += k

    def run(fail=False):
        def broken(df, batch):
            raise RuntimeError("stopped")

        df = spark.readStream.format(connector.NAME).options(path=str(source), split_bytes="100").load()
        w = df.writeStream.option("checkpointLocation", str(place)).trigger(availableNow=True)
        q = (w.foreachBatch(broken) if fail else w.foreachBatch(lambda b, i: b.select("payload").write.mode("overwrite").json(f"{sink}/batch={i}"))).start()
        if fail:
            with pytest.raises(Exception, match="stopped"):
                q.awaitTermination()
        else:
            q.awaitTermination()

    add("a", 50)
    run()
    assert collected(spark, sink) == list(range(n))
    add("b", 30)
    add("a", 20, end="")  # the last line isn't whole yet
    run(fail=True)
    add("c", 5)
    run()  # the failed batch again, then what came since
    assert collected(spark, sink) == [i for i in range(n - 5) if i != 99]
    run()
    assert collected(spark, sink) == [i for i in range(n) if i != 99]
    add("a", 0)
    run()
    run()
    assert collected(spark, sink) == list(range(n)) and n == 105


def test_stream_from_the_end_and_a_file_begun_anew(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a").write_text('{"n": 1}\n{"n": 2}\n')
    reader = connector.EventStream(connector.Options({"path": str(source), "position": "end"}))
    start = reader.initialOffset()
    (source / "a").write_text('{"n": 3}\n')
    (source / "b").write_text('{"n": 4}\nhalf')
    end = reader.latestOffset()
    assert (start, end) == ({"a": 18}, {"a": 9, "b": 9})
    rows = [r for p in reader.partitions(start, end) for b in reader.read(p) for r in b.column("payload").to_pylist()]
    assert rows == ['{"n": 3}', '{"n": 4}'] and reader.partitions(end, end) == []
    with pytest.raises(ValueError):
        connector.Options({"path": "x", "position": "middle"})


def test_health_of_a_stream(spark, tmp_path):
    connector.register(spark)
    source, path = tmp_path / "in", str(tmp_path / "health")
    source.mkdir()
    listener = connector.HealthListener(spark, path, "logs")
    spark.streams.addListener(listener)
    try:
        for k in range(3):
            (source / f"f{k}").write_text('{"n": 1}\n' * 10 + "broken\n" * (k == 1))
            df = connector.observed(spark.readStream.format(connector.NAME).options(path=str(source)).load())
            q = df.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "place")).trigger(availableNow=True).start()
            q.awaitTermination()
            deadline = time.time() + 60
            while time.time() < deadline:  # the listener is told later
                found = connector.health(spark, path).first() if (tmp_path / "health").exists() else None
                if found and found.state == "disconnected" and found.delivered == 10 * (k + 1):
                    break
                time.sleep(0.2)
        assert (found.source_id, found.state, found.delivered, found.errors) == ("logs", "disconnected", 30, 1) and found.last_event_at
        states = {r.batch: r.state for r in spark.read.schema(connector.HEALTH).json(path).where("batch is not null").collect()}
        assert states == {0: "connected", 1: "degraded", 2: "connected"}
    finally:
        spark.streams.removeListener(listener)

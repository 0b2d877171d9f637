import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.sources import dataflash, logscan

TYPES = [(1, "GPS", "QBcLf", "TimeUS,Status,HDop,Lat,Alt"), (2, "MSG", "QZ", "TimeUS,Message"), (3, "ODD", "bBhHiIfdnNZcCeELMqQ", ",".join("abcdefghijklmnopqrs")), (4, "NONE", "??", "x,y"), (5, "DUP", "BB", "a,a")]


def noisy(seed, n=300):
    """A log with noise, records cut short, marks inside payloads, descriptions that come late, replace others, or are none."""
    rng = random.Random(seed)
    out = dataflash.written(TYPES, [])
    for _ in range(n):
        what = rng.random()
        if what < 0.5:
            out += dataflash.written(TYPES, [(1, (rng.randrange(2**63), rng.randrange(256), 120, rng.randrange(-10**9, 10**9), rng.random()))])[len(dataflash.written(TYPES, [])) :]
        elif what < 0.7:
            out += b"\xa3\x95\x02" + rng.randrange(2**64).to_bytes(8, "little") + rng.choice([b"hello ", b"\xa3\x95\x01", b"\xa3\x95\x80xy", b"\xff\0a"]).ljust(64, b"\0")
        elif what < 0.8:
            out += b"\xa3\x95\x03" + rng.randbytes(dataflash.struct.Struct("<" + "".join(dataflash.CODES[c] for c in TYPES[2][2])).size)
        elif what < 0.85:
            out += b"\xa3\x95" + rng.randbytes(1) + rng.randbytes(rng.randrange(40))
        elif what < 0.9:
            out += rng.choice([b"\xa3", b"\xa3\x95", b"\xa3\xa3\x95\x01", b"noise", b"\xa3\x95\x05\x01\x02", b"\xa3\x95\x04"])
        elif what < 0.93:
            kind = rng.choice([1, 6, 7, 8])
            out += b"\xa3\x95\x80" + dataflash.DESCRIBED.pack(kind, rng.choice([0, 2, 3, 5, 12, 34, 200]), rng.choice([b"GPS", b"NEW", b"", b"\0"]), rng.choice([b"B", b"QBcLf", b"", b"?"]), b"TimeUS, b ,,c")
        else:
            out += rng.randbytes(rng.randrange(200))
    return out[: len(out) - rng.randrange(30)]



def test_ranges_read_what_one_walk_reads(spark, tmp_path):
    logs = {f"{i}.{'BIN' if i % 2 else 'bin'}": noisy(i) for i in range(6)} | {"long.BIN": b"\0" * 5_000 + noisy(9), "none.BIN": b"nothing here" * 30, "tiny.bin": b"x", "empty.bin": b"", "text.txt": b"\xa3\x95"}
    for name, data in logs.items():
        (tmp_path / name).write_bytes(data)
    want = {}
    for name, data in logs.items():
        if name not in ("text.txt", "empty.bin", "tiny.bin"):
            want[name] = [(i, at, n, repr(f)) for i, (at, n, f) in enumerate(dataflash.scanned(data, dataflash.descriptions(data)))]
    for split, before in ((1 << 20, 1 << 16), (700, 100), (64, 0)):  # with nothing before, most ranges must be walked again
        found = logscan.Logs(spark, f"file://{tmp_path}", split, before)
        rows = found.records().collect()
        assert {r.file: r.error for r in rows if r.error} == {"none.BIN": "no description", "tiny.bin": "too small", "empty.bin": "too small"}
        got = {name: [] for name in want}
        for r in sorted((r for r in rows if not r.error), key=lambda r: (r.file, r.seq)):
            got[r.file].append((r.seq, r.offset, r.name, repr(dict(dataflash_json(r.fields)))))
        for name in want:
            assert got[name] == [(s, o, n, repr(dict(dataflash_json(as_json(f))))) for (s, o, n, _), f in zip(want[name], (f for _, _, f in dataflash.scanned(logs[name], dataflash.descriptions(logs[name]))))], (name, split)
        if split == 64:
            assert found.walked.count() > 500
    types = {(r.file, r.type_id): (r.length, r.name, r.format, list(r.columns)) for r in found.types().collect()}
    assert types == {(name, k): (t[0], t[1], t[2], [n for n, _ in t[3]]) for name, data in logs.items() if name.lower().endswith("bin") for k, t in dataflash.descriptions(data).items()}


def as_json(fields):
    import json

    return json.dumps(fields)


def dataflash_json(text):
    import json

    return json.loads(text)


def test_typed_columns(spark, tmp_path):
    data = noisy(3)
    (tmp_path / "a.BIN").write_bytes(data)
    other = [(7, "ODD", "Zf", "a,zz"), (1, "FMTX", "B", "seq")]
    (tmp_path / "b.BIN").write_bytes(dataflash.written(other, [(7, (b"text", 1.5)), (1, (7,))]))
    logs = logscan.Logs(spark, f"file://{tmp_path}", 1000)
    want = [(at, f) for at, n, f in dataflash.scanned(data, dataflash.descriptions(data)) if n == "ODD"]
    got = logs.typed("ODD").orderBy("file", "offset").collect()
    assert [r.offset for r in got if r.file == "a.BIN"] == [at for at, _ in want] and len(want) > 10
    for r, (_, fields) in zip(got, want):
        for name, value in fields.items():
            found = r[name]
            if name == "a":  # a number in one file, a text in the other
                assert found == str(value)
            elif isinstance(value, float):
                assert found == value or math.isnan(found) and math.isnan(value)
            else:
                assert found == value, name
        assert r["zz"] is None
    assert [(r["a"], r["zz"], r["b"]) for r in got if r.file == "b.BIN"] == [("text", 1.5, None)]
    clash = logs.typed("FMTX").collect()  # a field called as one of the scan's own columns
    assert [(r["seq"], r["seq_"]) for r in clash] == [(1, 7)]
    kinds = dict(logs.typed("ODD", "GPS").dtypes)
    assert (kinds["Lat"], kinds["Status"], kinds["TimeUS"], kinds["a"], kinds["j"]) == ("double", "bigint", "decimal(20,0)", "string", "string")
    assert logs.typed("GONE").count() == 0


def test_large_file_in_many_tasks(spark, tmp_path):
    records = [(1, (i + 1, 3, 100, 10**7 * (i % 90), float(i))) for i in range(40_000)]
    (tmp_path / "big.BIN").write_bytes(dataflash.written(TYPES, records))
    logs = logscan.Logs(spark, f"file://{tmp_path}", 50_000)
    gps = logs.typed("GPS")
    assert logs.walked.count() > 15
    assert gps.agg(F.count("*"), F.sum("Alt"), F.max("seq"), F.sum("Lat")).first() == (40_000, sum(map(float, range(40_000))), 39_999, sum(i % 90 for i in range(40_000)))


def test_writes_logs(spark, tmp_path):
    rows = [(f"f{i % 3}", i, 1, [i + 1.0, 3.0, 120.0, 5e8 + i, 0.5 * i]) for i in range(30)]
    logscan.write_logs(spark.createDataFrame(rows, "file string, seq long, type_id int, values array<double>"), f"file://{tmp_path}/logs", TYPES)
    got = logscan.Logs(spark, f"file://{tmp_path}/logs").typed("GPS").collect()
    assert sorted((r.file, r.seq, int(r.TimeUS), r.HDop, r.Alt) for r in got) == sorted((f"f{i % 3}.BIN", i // 3, i + 1, 1.2, 0.5 * i) for i in range(30))


def test_marks_in_numbers_describe_nothing(spark, tmp_path):
    mark = int.from_bytes(b"\xa3\x95\x80\x07\x25\x46\x06\0", "little")  # a time whose bytes are those of a description of type 7
    records = [(1, (mark + (i << 32), 3, 100, 10**7, 1.0)) for i in range(50)]
    data = dataflash.written(TYPES, records)
    (tmp_path / "a.BIN").write_bytes(data)
    logs = logscan.Logs(spark, f"file://{tmp_path}", 500)
    assert sorted(r.type_id for r in logs.types().collect()) == sorted(dataflash.descriptions(data)) == [1, 2, 3, 4, 5]
    assert [r.TimeUS for r in logs.typed("GPS").orderBy("seq").collect()] == [r[1][0] for r in records]


def test_ranges_stay_in_many_tasks(spark, tmp_path):
    (tmp_path / "a.BIN").write_bytes(dataflash.written(TYPES, [(1, (i + 1, 3, 100, 10**7, 1.0)) for i in range(5_000)]))
    logs = logscan.Logs(spark, f"file://{tmp_path}", 4_000)
    for df in (logs.cuts, logs.typed("GPS").select("seq"), logs.records().where("error is null").select("seq")):
        busy = df.select(F.spark_partition_id().alias("p")).distinct().count()
        assert busy >= 3  # of the session's 4


def test_records_are_laid_out_as_packed():
    rng = random.Random(5)
    codes = {c: dataflash.CODES[c] for c in "bBhHiIfdcCeELMqQ"}
    types = [(1, "ONE", "".join(codes), "a"), (2, "TWO", "QBd", "a"), (3, "NONE", "??", "a")]
    rows = []
    for i in range(300):
        kind = rng.choice([1, 2, 3])
        values = {1: [float(rng.randrange(100)) + 0.5 for _ in codes], 2: [2.0**53 + rng.randrange(9) * 2, rng.randrange(256) + 0.9, rng.random()], 3: []}[kind]
        rows.append((rng.randrange(60), kind, values))
    rows += [(7, 2, [3.0, 2.0, 1.0]), (7, 2, [3.0, 1.0, 1.0]), (7, 2, [1.0, 255.0, 1.0])] * 2
    whole = {k: [dataflash.CODES[c] not in "fd" for c in f if c in dataflash.CODES] for k, _, f, _ in types}
    want = dataflash.written(types, [(k, [int(x) if w else x for x, w in zip(v, whole[k])]) for _, k, v in sorted(rows)])

    def table(rows):
        columns = pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))
        return pa.table(columns, ["seq", "type_id", "values"])

    assert dataflash.written(types, []) + bytes(logscan.laid_out(table(rows), types)) == want
    assert bytes(logscan.laid_out(table([]), types)) == b""
    for wrong in ([(1, 2, [-1.0, 1.0, 1.0])], [(1, 2, [1.0, 256.0, 1.0])], [(1, 2, [2.0**64, 1.0, 1.0])], [(1, 2, [1.0, 1.0])], [(1, 9, [])], [(1, 2, [1.0, None, 1.0])], [(None, 3, [])], [(1, 2, [float("nan"), 1.0, 1.0])], [(1, 1, [0.0] * 6 + [1e300] + [0.0] * 9)]):
        with pytest.raises(ValueError):
            logscan.laid_out(table(wrong), types)

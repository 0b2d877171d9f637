import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import analyses, features, flatten, learning, relations, roles, telemetry
from lodestrata.plans import profile
from lodestrata.sources import dataflash, events, logscan
from lodestrata.streaming import live


def test_flatten_nested(spark):
    rows = [json.dumps({"a": 1, "b": {"c": [True, None, {"d": "x"}]}, "e": {}, "f": []}), None, "{broken", "{}"]
    df = spark.createDataFrame(list(enumerate(rows)), "seq long, payload string")
    assert sorted((r.path, r.value) for r in flatten.flatten_json(df, "seq", "payload").collect()) == [("a", "1"), ("b.c.0", "True"), ("b.c.1", None), ("b.c.2.d", "x")]
    typed = spark.createDataFrame([(0, (1, [("p", 2), ("q", None)]), [5, 6]), (1, None, [])], "seq long, s struct<a:int,b:array<struct<c:string,d:int>>>, l array<int>")
    found = sorted((r.seq, r.path, r.value) for r in flatten.flatten_columns(typed, "seq").collect())
    assert found == sorted([(0, "s.a", "1"), (0, "s.b.0.c", "p"), (0, "s.b.0.d", "2"), (0, "s.b.1.c", "q"), (0, "s.b.1.d", None), (0, "l.0", "5"), (0, "l.1", "6"), (1, "s.a", None)], key=lambda r: r)


def test_features_of_edge_values(spark):
    data = [("ip", f"10.0.0.{i}") for i in range(6)] + [("none", None)] * 3 + [("half", v) for v in ("a", None, "b", None)] + [("hex", "d41d8cd98f00b204e9800998ecf8427e")] * 3 + [("empty", "")]
    found = {r.path: r for r in features.field_features(spark.createDataFrame(data, "path string, value string")).collect()}
    assert found["ip"].dot_ratio == 1 and found["ip"].numeric_ratio > 0.5 and found["ip"].is_numeric_ratio == 0
    assert found["none"].null_count == 3 and found["none"].samples == [] and all(found["none"][k] == 0 for k in features.NAMES)
    assert (found["half"].null_ratio, found["half"].unique_count) == (0.5, 2)
    assert found["hex"].has_fixed_length == 1 and found["hex"].hex_ratio == 1 and found["hex"].cardinality_ratio == pytest.approx(1 / 3)
    assert found["empty"].mean_length == 0
    assert features.field_features(spark.createDataFrame([], "path string, value string")).count() == 0


def test_hints(spark):
    cases = {"ipv4": ["1.2.3.4", "250.0.0.1"], None: ["999.2.3.4", "300.1.1.1"], "url": ["http://a.b", "https://c"], "fqdn": ["a.b.c", "web.example.org"], "hash_sha1": ["a" * 40] * 2, "mac": ["aa-bb-cc-dd-ee-ff"], "ipv6": ["fe80::1:2", "::1:2"]}
    df = spark.createDataFrame(list(cases.items()), "want string, samples array<string>")
    assert all(r.want == r.got for r in df.withColumn("got", roles.type_hint(F.col("samples"))).collect())


def test_mutual_information(spark):
    df = spark.createDataFrame([(5, 5, 7, 8), (3, 4, 4, 5), (5, 5, 5, 5), (2, 4, 4, 8)], "c long, a long, b long, n long")
    got = [r.m for r in df.select(relations.mutual_information(*map(F.col, "cabn")).alias("m")).collect()]
    assert got == pytest.approx([0.1992, 0.0729, 0, 0], abs=5e-5)


def test_verdict_confidence(spark):
    rows = [(1, "position_jump", "CLEAN"), (1, "alt_divergence", "UNKNOWN"), (1, "gps_quality", "CLEAN"), (1, "ekf_innovation", "CLEAN")]
    rows += [(2, *r[1:]) for r in rows[:3]] + [(2, "ekf_innovation", "SUSPICIOUS")] + [(3, *r[1:]) for r in rows[:3]] + [(3, "ekf_innovation", "ALERT")] + [(4, "position_jump", "UNKNOWN")]
    got = {r.file: (r.verdict, round(r.confidence, 4)) for r in telemetry.weighted_verdict(spark.createDataFrame(rows, "file long, check string, verdict string")).collect()}
    assert got == {1: ("CLEAN", 0.375), 2: ("SUSPICIOUS", 0.45), 3: ("ALERT", 0.525), 4: ("UNKNOWN", 0.0)}


def machine(statuses):
    had = lost = False
    n = 0
    for s in statuses:
        if s >= 3:
            n += lost
            had, lost = True, False
        elif s <= 1 and had:
            lost = True
    return n


def test_glitches_batch_and_stream(spark, tmp_path):
    random.seed(3)
    runs = {f: [random.randint(0, 4) for _ in range(random.randint(1, 30))] for f in range(40)}
    df = spark.createDataFrame([(f, i, s) for f, r in runs.items() for i, s in enumerate(r)], "file long, seq long, status long")
    want = {f: machine(r) for f, r in runs.items()}
    got = {r.file: r.glitches for r in telemetry.gps_glitches(df).collect()}
    assert all(got.get(f, 0) == n for f, n in want.items())
    df.where("seq < 15").coalesce(1).write.parquet(str(tmp_path / "in/a"))
    df.where("seq >= 15").coalesce(1).write.parquet(str(tmp_path / "in/b"))
    stream = live.glitches(live.tail(spark, str(tmp_path / "in/*"), df.schema))
    q = stream.writeStream.outputMode("update").format("memory").queryName("glitches").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {r.file: r.g for r in spark.table("glitches").groupBy("file").agg(F.max("glitches").alias("g")).collect()}
    assert set(last) == set(want)


def test_stream_rates(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = live.rates(live.tail(spark, str(tmp_path / "in"), src.schema), "ts", ["event_type"], "1 day")
    q = out.writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("rates").agg(F.sum("n")).first()[0] == src.count()


def test_nearest_in_time(spark):
    random.seed(5)
    left = [(f, i, random.randint(0, 60)) for f in (1, 2) for i in range(60)]
    right = [(1, i, t, float(i)) for i, t in enumerate(sorted(random.randint(0, 60) for _ in range(12)))]
    got = telemetry.nearest_in_time(spark.createDataFrame(left, "file long, seq long, t long"), spark.createDataFrame(right, "file long, seq long, t long, alt double"), 4)
    for r in got.collect():
        near = min(((abs(t - r.t), t, s, alt) for f, s, t, alt in right if f == r.file), default=None)
        assert (r.gap, r.other) == ((near[0], near[3]) if near and near[0] <= 4 else (None, None))


def test_log_round_trip(spark, tmp_path):
    types = [(1, "GPS", "QBBcLLe", "TimeUS,Status,NSats,HDop,Lat,Lng,Alt"), (2, "BARO", "Qf", "TimeUS,Alt"), (3, "XKF1", "Qff", "TimeUS,IVN,IVE"), (4, "PARM", "QNf", "TimeUS,Name,Value"), (5, "ODD", "Q?H", "TimeUS,skip,last")]
    records = []
    for i in range(8):
        records += [(1, (1_000_000 * (i + 1), 3, 9, 120, -353632610 + i, 1491652300, 58400)), (2, (1_000_000 * (i + 1) + 500, 10.5)), (3, (1_000_000 * (i + 1), 3.0, 4.0 if i else 12.0))]
    records += [(4, (5, b"GPS_TYPE", 1.0)), (5, (7, 77))]
    data = dataflash.written(types, records)
    (tmp_path / "one.BIN").write_bytes(b"noise" + data[:-30] + b"\xa3\x95\x63junk" + data[-30:])
    (tmp_path / "two.bin").write_bytes(data[:-3])
    (tmp_path / "bad.BIN").write_bytes(b"\xa3\x95\x01nothing")
    (tmp_path / "tiny.bin").write_bytes(b"x")
    rows = logscan.read_logs(spark, str(tmp_path))
    errors = {r.file: r.error for r in rows.where("error is not null").collect()}
    assert errors == {"bad.BIN": "no description", "tiny.bin": "too small"}
    good = rows.where("file = 'two.bin'")
    assert good.where("name <> 'ODD'").count() == 25 and good.where("name = 'ODD'").count() == 0  # the last record is cut off
    g = dataflash.gps(good)
    first = g.orderBy("seq").first()
    assert (first.status, first.nsats, first.hdop, first.alt) == (3, 9, 1.2, 584.0) and first.lat == pytest.approx(-35.363261)
    findings = telemetry.spoof_findings(g, dataflash.baro(good), dataflash.ekf(good))
    assert {r.check: r.verdict for r in findings.collect()} == {"position_jump": "CLEAN", "alt_divergence": "CLEAN", "gps_quality": "CLEAN", "ekf_innovation": "ALERT"}
    assert telemetry.config_fingerprint(dataflash.params(good)).count() == 1
    assert {r.name for r in logscan.read_types(spark, str(tmp_path)).where("file = 'two.bin'").collect()} == {"GPS", "BARO", "XKF1", "PARM", "ODD"}


def test_events_in_order_of_file_and_line(spark, tmp_path):
    """Small files before large ones in a task, and files in several splits: seq still follows path and line."""
    sizes = {"a.jsonl": 30_000, "b.jsonl": 3, "c.jsonl": 9_000, "d.jsonl": 1}
    for name, n in sizes.items():
        (tmp_path / name).write_text("".join(f"{name} {i}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        got = [r.payload for r in events.read_events(spark, str(tmp_path), "*.jsonl").orderBy("seq").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [f"{name} {i}" for name in sorted(sizes) for i in range(sizes[name])]


def test_sources_and_corrections(spark, tmp_path):
    assert list(events.sources({"SOURCE_2_TYPE": "a", "SOURCE_10_TYPE": "b", "SOURCE_3_PATH": "x", "OTHER": "1"})) == ["10", "2"]
    path = str(tmp_path / "log")
    one = spark.createDataFrame([("s", "p", "id", "entity", None, "enum", 0.123456, "t")], events.CORRECTION)
    events.append_corrections(one, path)
    (tmp_path / "log" / "more.json").write_text('{"source_id": "s"}\nnot json\n\n')
    got = events.read_corrections(spark, path).collect()
    assert len(got) == 1 and got[0].original_confidence == 0.1235
    with pytest.raises(Exception, match="invalid label"):
        events.append_corrections(one.withColumn("correct_label", F.lit("nonsense")), path)


def test_forest_and_clusters(spark):
    examples = learning.bootstrap(spark, 8)
    model, state = learning.retrain(None, examples, examples.limit(5), 0)
    assert (model, state) == (None, "skipped")
    model = learning.train(examples, 30)
    out = learning.predict(model, examples.select("path", F.col("label").alias("want"), "feature_vector"))
    assert out.where("want = label").count() >= 0.9 * out.count()
    found = learning.clusters(examples).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.path.split("/")[0], set()).add(r.cluster)
    assert len({tuple(sorted(v)) for v in groups.values()}) >= 3
    assert {r.cluster for r in learning.clusters(examples.limit(4)).collect()} == {-1}


def test_profile_is_whole(spark):
    leaves = spark.createDataFrame([(i, "ip", f"10.0.0.{i % 19}") for i in range(60)] + [(i, "level", str(i % 3)) for i in range(60)], "seq long, path string, value string")
    found = profile.source_profile(leaves, 60, "src")
    p = found.first()
    assert p.revision == 1 and len(p.fingerprint) == 16 and {f.path: f.role for f in p.fields} == {"ip": "entity", "level": "metric"}
    ip = next(f for f in p.fields if f.path == "ip")
    assert math.isclose(ip.profile_cardinality, 19 / 60) and (ip.type_hint, ip.is_entity, ip.confidence, ip.cluster_id, ip.sample_count, ip.null_count, ip.unique_count) == ("ipv4", True, 0.5, -1, 60, 0, 19)
    later = profile.source_profile(leaves, 60, "src", found.withColumn("revision", F.lit(4)).withColumn("created_at", F.lit("2020-01-01").cast("timestamp"))).first()
    assert later.revision == 5 and later.created_at.year == 2020
    again = profile.from_json(profile.to_json(found))
    assert again.schema.simpleString() == found.schema.simpleString() and again.drop("created_at").first() == found.drop("created_at").first()


def test_profile_filters(spark):
    leaves = spark.createDataFrame([(i, p, v) for i in range(40) for p, v in (("src", f"10.0.0.{i % 9}"), ("dst", f"10.1.0.{i % 7}" if i % 2 else None), ("n", str(i)), ("when", f"2024-01-01T00:00:{i:02d}Z"))], "seq long, path string, value string")
    found = profile.source_profile(leaves, 40, "s")
    assert {r.path for r in profile.fields_of(found, role="entity").collect()} == {"src", "dst"} == {r.path for r in profile.fields_of(found, hint="ipv4").collect()}
    assert [r.role for r in profile.fields_of(found, path="when").collect()] == ["temporal"] and profile.fields_of(found, path="none").count() == 0
    assert {r.role: r.n for r in profile.role_counts(found).collect()} == {"entity": 2, "metric": 1, "temporal": 1}
    assert [r.path for r in profile.listing(found).collect()] == ["dst", "src", "n", "when"]
    assert profile.relationships_of(found, "src", "dst").count() == profile.relationships_of(found).count() == 0  # one of them is always there: no information
    empty = profile.source_profile(leaves.where("1 = 0"), 0, "s").first()
    assert (empty.fields, empty.relationships) == ([], [])


def test_fingerprint_escapes_paths(spark):
    import hashlib

    paths = ['a"b', "c\\d", "e"]
    leaves = spark.createDataFrame([(0, p, "v") for p in paths], "seq long, path string, value string")
    assert profile.fingerprint(leaves).first().fingerprint == hashlib.sha256(json.dumps(sorted(paths)).encode()).hexdigest()[:16]


def test_decisions(spark):
    from lodestrata.operators import learning

    fields = spark.createDataFrame([("a", "enum", ["x"]), ("b", "enum", ["x"]), ("c", "metric", ["1"]), ("d", "text", ["y"])], "path string, role string, samples array<string>")
    predicted = spark.createDataFrame([("a", "entity", 0.9, False), ("b", "entity", 0.5, True), ("c", "entity", 0.8, False), ("d", "text", 0.7, False)], "path string, label string, confidence double, flagged boolean")
    found = spark.createDataFrame([("a", 0), ("b", 0), ("c", -1)], "path string, cluster int")
    view = lambda m: {r.path: (r.role, r.confidence, r.cluster_id, r.is_entity) for r in learning.decided(fields, m, found).collect()}
    assert view(predicted) == {"a": ("entity", 0.9, 0, True), "b": ("enum", 0.5, 0, False), "c": ("entity", 0.5, -1, True), "d": ("unknown", 0.0, -1, False)}
    assert view(None) == {"a": ("enum", 0.5, 0, False), "b": ("enum", 0.5, 0, False), "c": ("metric", 0.5, -1, False), "d": ("unknown", 0.0, -1, False)}
    assert learning.stats("s", None)["model_status"] == "cold"


def test_explore_edges(spark):
    from lodestrata.operators import explore

    same = spark.createDataFrame([(5.0,)] * 3 + [(None,)], "value double")
    assert [(r.bin, r.n) for r in explore.histogram(same).collect()] == [(0, 3)] and explore.histogram(same.where("1 = 0")).count() == 0
    names = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("b", "y"), ("b", "z"), ("c", "q")], "file string, name string")
    assert {(r.kind, r.name) for r in explore.set_comparison(names, "a", "b").collect()} == {("only_a", "x"), ("common", "y"), ("only_b", "z")}
    assert {(r.name, r.a, r.b, r.c) for r in explore.type_matrix(names).collect()} == {("x", 1, 0, 0), ("y", 2, 1, 0), ("z", 0, 1, 0), ("q", 0, 0, 1)}
    assert {(r.name, r.files) for r in explore.all_names(names).collect()} == {("x", 1), ("y", 2), ("z", 1), ("q", 1)}
    many = spark.createDataFrame([("f", i, float(i)) for i in range(700)] + [("g", 0, None)], "name string, seq long, value double")
    got = {r.name: r for r in explore.field_stats(many, ["name"]).collect()}
    assert (got["f"].uniques, got["f"].lo, got["f"].hi, got["f"].samples) == (500, 0.0, 699.0, [0.0, 1.0, 2.0, 3.0, 4.0]) and (got["g"].uniques, got["g"].samples) == (0, [])
    sweep = spark.createDataFrame([(0.1, 1.0, 0.5), (0.2, 1.0, 0.0), (0.3, 1.0, 0.0)], "threshold double, tpr double, fpr double")
    assert explore.best_threshold(sweep).first().optimal == 0.2


def test_nearest_in_time_is_linear(spark):
    """No frame runs ahead of its row, and a file of 200,000 points is done in seconds."""
    import contextlib
    import io
    import time

    n = 200_000
    left = spark.range(n).select(F.lit(1).cast("long").alias("file"), F.col("id").alias("seq"), (F.col("id") * 10).alias("t"))
    right = spark.range(n // 2).select(F.lit(1).cast("long").alias("file"), F.col("id").alias("seq"), (F.col("id") * 20 + 3).alias("t"), F.col("id").cast("double").alias("alt"))
    out, began = telemetry.nearest_in_time(left, right), time.time()
    with contextlib.redirect_stdout(io.StringIO()) as said:
        out.explain()
    assert "unboundedfollowing" not in said.getvalue().lower()
    row = out.agg(F.sum("gap").alias("g"), F.count("other").alias("n")).first()
    assert row.n == n and time.time() - began < 90
    assert row.g == sum(min(abs(10 * i - (20 * j + 3)) for j in ((10 * i - 3) // 20, (10 * i - 3) // 20 + 1) if 0 <= j < n // 2) for i in range(n))


def test_corpus_of_logs(spark, tmp_path):
    from lodestrata.plans import corpus

    types = [(1, "GPS", "QBBcLLe", "TimeUS,Status,NSats,HDop,Lat,Lng,Alt"), (2, "BARO", "Qf", "TimeUS,Alt"), (3, "ERR", "QBB", "TimeUS,Subsys,ECode"), (4, "PARM", "QNf", "TimeUS,Name,Value"), (5, "MODE", "QM", "TimeUS,Mode"), (6, "MSG", "QZ", "TimeUS,Message")]
    point = lambda i, status: (1, (1_000_000 * (i + 1), status, 9, 120, -353632610, 1491652300, 58400))
    logs = {
        "fly.BIN": [point(i, 3) for i in range(40)] + [(2, (1_000_000 * i + 1, 1.0 + i)) for i in range(40)] + [(4, (1, b"GPS_TYPE", 1.0)), (6, (1, b"ArduCopter V4.1 ")), (6, (2, b"Frame: QUAD"))],
        "err.BIN": [point(i, (3, 1)[i % 2]) for i in range(10)] + [(3, (9, 6, 1)), (3, (9, 10, 2))],
        "short.BIN": [point(0, 0), point(1, 0)],
    }
    for name, records in logs.items():
        (tmp_path / name).write_bytes(dataflash.written(types, records))
    (tmp_path / "none.BIN").write_bytes(b"nothing here")
    rows = logscan.read_logs(spark, str(tmp_path))
    files = corpus.inventory(rows, logscan.read_types(spark, str(tmp_path)))
    fly = files.where("file = 'fly.BIN'").first()
    assert (fly.firmware_version, fly.logging_frequencies, fly.err_codes) == ("ArduCopter V4.1", {"BARO": 1.0, "GPS": 1.0}, None)
    assert fly.message_types_present == ["BARO", "ERR", "GPS", "MODE", "MSG", "PARM"]
    assert [(e.subsys, e.ecode) for e in files.where("file = 'err.BIN'").first().err_codes] == [(6, 1), (10, 2)]
    got = {r.file: (r.session_type, r.verdict, r.reasons) for r in files.collect()}
    assert got["fly.BIN"] == ("flight", "clean_baseline", []) and got["short.BIN"] == ("ground", "exclude", ["duration_too_short"])
    assert got["err.BIN"][1:] == ("contains_deviations", ["err_count=2", "gps_glitches=4", "compass_warnings=1", "arming_failures=1"]) and got["none.BIN"][1:] == ("exclude", ["no_schema"])
    present = spark.createDataFrame([("fly.BIN",)], "file string")
    assert [r.file for r in corpus.selected(files, present, names=["fly.BIN", "err.BIN"]).collect()] == ["fly.BIN"]
    whole = corpus.summary(files).first()
    assert (whole.files, whole.total_files, whole.verdict_counts) == (3, 4, {"clean_baseline": 1, "contains_deviations": 1, "exclude": 2})
    assert whole.median_hz == {"BARO": 1.0, "GPS": 1.0} and whole.session_type_counts["unknown"] >= 1
    assert {r.fingerprint: r.count for r in corpus.by_fingerprint(files).collect()} and sum(len(r.files) for r in corpus.by_fingerprint(files).collect()) == 4
    corpus.sink(files, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 4
    total = corpus.analysis_summary(corpus.analyzer("gps_spoof")(rows)).first()
    assert total.total_files == 3 and total.alert_files == ["fly.BIN"] and sum(total.verdict_counts.values()) == 3
    with pytest.raises(ValueError):
        corpus.analyzer("none")
    results = corpus.analysis(rows)
    assert {r.file: r.verdict for r in results.collect()}["fly.BIN"] == "ALERT"  # the barometer climbs, the position doesn't
    assert corpus.report(results).count() == 3

    class Broken(analyses.Check):
        name = "broken"

        def see(self, row):
            raise OSError("no")

    more = corpus.analysis(rows, [Broken])
    plain = {r.file: (r.verdict, r.confidence, {f.check: f.verdict for f in r.findings}) for r in results.collect()}
    assert {r.file: (r.verdict, r.confidence, {f.check: f.verdict for f in r.findings if f.check != "broken"}) for r in more.collect()} == plain
    assert {f.verdict for r in more.collect() for f in r.findings if f.check == "broken"} <= {"ERROR", "UNKNOWN"}


def test_checks(spark, tmp_path):
    from lodestrata.operators import checks

    predicted = spark.createDataFrame([("a.b.c", "entity", 0.9), ("a.x", "enum", 0.5), ("z", "text", 0.55)], "path string, role string, confidence double")
    known = spark.createDataFrame([("a.b", "entity", 1), ("a", "metric", 2), ("q", "text", 0)], "pattern string, role string, rank int")
    got = checks.against_known(predicted, known)
    assert {r.path: (r.expected, r.correct) for r in got.collect()} == {"a.b.c": ("entity", True), "a.x": ("metric", False), "z": (None, None)}
    a = checks.accuracy(got).first()
    assert (a.checked, a.correct, a.by_classifier, a.flagged, a.percent) == (2, 1, 2, 2, 50)
    examples = learning.bootstrap(spark, 4)
    assert len(examples.select(checks.vector_id("label", "path", "feature_vector").alias("i")).distinct().collect()) == 20
    model = learning.train(examples, 5)
    models = checks.Models(str(tmp_path / "models"))
    models.put("src", model, learning.stats("src", model, 20))
    again, about = checks.Models(str(tmp_path / "models")).get("src")
    assert (about["model_status"], about["training_samples"], sorted(about["classes"])) == ("trained", 20, sorted({"entity", "metric", "enum", "temporal", "text"}))
    assert models.get("other") == (None, {})
    assert learning.retrain(model, examples, examples, 0, dry_run=True) == (model, "ready") and learning.retrain(None, examples.limit(0), examples.limit(0), 0, force=True) == (None, "empty")
    odd = spark.createDataFrame([("short", [1.0])], "path string, feature_vector array<double>")
    assert [(r.label, r.flagged) for r in learning.predict(model, odd).collect()] == [(None, None)] == [(r.label, r.flagged) for r in learning.predict(None, odd).collect()]
    view = lambda m: sorted((r.path, r.label) for r in learning.predict(m, examples.select("path", "feature_vector")).collect())
    assert view(model) == view(again)

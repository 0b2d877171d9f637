"""Checks by table function against the same by joins and windows, and what becomes of checks that fail."""

import random

import pytest
from pyspark.errors import AnalysisException

from lodestrata.operators import analyses, telemetry

GPS = "file string, seq long, t long, lat double, lon double, status long, nsats long, hdop double, alt double"


def own():
    """Checks that travel to the workers with the function, since they are in no module that these have."""

    class Counts(analyses.Check):
        name = "counts"

        def __init__(self):
            self.seqs = []

        def see(self, row):
            self.seqs.append(row["seq"])

        def finding(self):
            return "CLEAN", ",".join(map(str, self.seqs)), len(self.seqs), None

    class Fails(analyses.Check):
        """Fails at its start, at a row, at its end or with a verdict that can't be kept, by the file."""

        name = "fails"

        def see(self, row):
            if row["file"] == "see":
                raise KeyError("x")
            self.file = row["file"]

        def finding(self):
            return ("CLEAN", None, None, None) if self.file == "good" else ("CLEAN", None, "much", None) if self.file == "value" else 1 / 0

    class Never(analyses.Check):
        name = "never"

        def __init__(self):
            raise RuntimeError("no")

    return Counts, Fails, Never


Counts, Fails, Never = own()


def tables(spark, seed):
    rng, gps, baro, ekf = random.Random(seed), [], [], []
    for k in range(24):
        jumpy, n = k % 4, rng.choice([1, 4, 5, 30, 80])
        lat, sats, hdop = -35.0, 9, 1.0
        for i in range(n):
            t = i * 200_000 + rng.randrange(50_000)
            lat += 1e-7 * rng.random() + (rng.choice([0, 0, 0, 2e-5, 5e-3]) if jumpy == 1 else 0)
            if jumpy == 2:
                hdop, sats = max(0.1, hdop + rng.choice([0, 0, 0, 0, 0.5, -0.5, -1.4, 2.5])), max(0, sats + rng.choice([0, 0, 0, 1, -1, -5]))
            status = rng.choice([3, 3, 3, 3, 1, 2, None]) if k % 3 else 3
            some = lambda v: None if k % 5 == 4 and rng.random() < 0.2 else v
            gps.append((f"f{k}", 2 * i, some(t), some(lat), 149.0, status, some(sats if k % 6 else 3), some(hdop), some(100 + rng.random() * rng.choice([1, 1, 1, 25 if jumpy == 3 else 2]))))
            if k % 8 and rng.random() < 0.7:
                baro.append((f"f{k}", 2 * i + 1, t + rng.randrange(-90_000, 90_000), 90.0 + rng.random()))
            if k % 7:
                ekf.append((f"f{k}", 2 * i + 1, t, some(rng.random() * rng.choice([3, 3, 8, 30 if k % 2 else 3])), some(rng.random())))
    ekf.append(("without positions", 1, 1, 99.0, 99.0))
    return spark.createDataFrame(gps, GPS), spark.createDataFrame(baro, "file string, seq long, t long, alt double"), spark.createDataFrame(ekf, "file string, seq long, t long, ivn double, ive double")


def test_as_by_joins_and_windows(spark):
    seen = set()
    for seed in (1, 2):
        data = tables(spark, seed)
        want = {(r.file, r.check): r.verdict for r in telemetry.spoof_findings(*data).collect()}
        rows = analyses.spoof_findings(*data).collect()
        assert {(r.file, r.check): r.verdict for r in rows} == want and len(rows) == len(want) == 24 * 4
        seen |= {(check, verdict) for (_, check), verdict in want.items()}
    assert {v for c, v in seen if c == "position_jump"} >= {"CLEAN", "ALERT"} and {v for c, v in seen if c == "gps_quality"} >= {"CLEAN", "SUSPICIOUS"}
    assert {v for c, v in seen if c == "alt_divergence"} >= {"CLEAN", "ALERT", "UNKNOWN"} and {v for c, v in seen if c == "ekf_innovation"} >= {"CLEAN", "SUSPICIOUS", "ALERT", "UNKNOWN"}


def test_a_failing_check_is_a_row_of_its_file(spark):
    rows = spark.createDataFrame([(f, i) for f in ("good", "see", "value", "end") for i in (3, 1, 2)], "file string, seq long").repartition(3)
    found = {(r.file, r.check): r for r in analyses.findings(rows, [Fails, Counts, Never]).collect()}
    assert len(found) == 12
    assert {f: found[f, "fails"].verdict for f in ("good", "see", "value", "end")} == {"good": "CLEAN", "see": "ERROR", "value": "ERROR", "end": "ERROR"}
    assert (found["see", "fails"].detail, found["end", "fails"].detail) == ("KeyError: 'x'", "ZeroDivisionError: division by zero")
    assert all(found[f, "counts"].detail == "1,2,3" and found[f, "never"].detail == "RuntimeError: no" for f in ("good", "see", "value", "end"))
    verdicts = telemetry.weighted_verdict(analyses.findings(rows, [Fails, Never])).collect()
    assert {r.file: (r.verdict, r.confidence) for r in verdicts} == {"good": ("CLEAN", 0.0), "see": ("UNKNOWN", 0.0), "value": ("UNKNOWN", 0.0), "end": ("UNKNOWN", 0.0)}


def test_type_of_file_few_rows_and_none(spark):
    rows = spark.createDataFrame([(7, 1, "gps"), (7, 2, "ekf"), (8, 1, "ekf"), (None, 2, "gps"), (None, 1, "gps")], "file int, seq long, kind string")
    found = analyses.findings(rows, [Counts], least=2, of="gps")
    assert found.schema["file"].dataType.simpleString() == "int"
    assert {r.file: (r.verdict, r.detail) for r in found.collect()} == {7: ("UNKNOWN", "1 rows of 2 needed"), None: ("CLEAN", "1,2")}
    assert analyses.findings(rows.where("false"), [Counts]).collect() == [] and analyses.findings(rows, []).collect() == []
    with pytest.raises(AnalysisException, match="needs seq"):
        analyses.findings(rows.drop("seq"), [Counts])

"""Checks of one's own: a table function that runs them over the rows of each file, in order.

A check is a small class that sees a file's rows one by one and holds a few numbers, so a file of any
length takes no memory.  The function is polymorphic: its result has the type that `file` has in the
table it is given, and it asks for the partitioning and order itself.  A check that raises gives an
ERROR row for that file, with the message; the file's other checks, and the other files, go on.

`telemetry.spoof_findings` says the same as the four checks here by joins and windows and is faster;
this is the way for checks that columns can't say.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from . import telemetry


class Check:
    """A check of a file. `see` is called for every row in order, `finding` once at the end: verdict, detail, value, time (None where there is none)."""

    name = ""

    def see(self, row) -> None:
        raise NotImplementedError

    def finding(self) -> tuple[str, str | None, float | None, int | None]:
        raise NotImplementedError


def findings(rows: DataFrame, checks: list[type[Check]], least: int = 0, of: str | None = None) -> DataFrame:
    """file, check, verdict, detail, value, t: a row for each file and check, in their order.

    rows: file, seq and whatever the checks look at. A file with fewer than `least` rows (of the kind
    `of`, by a column kind, where given) has UNKNOWN for every check, one without any of that kind no
    rows, rows without a file are one more file. Nothing for a table without rows.
    """

    class Run:
        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            kinds = {f.name: f.dataType for f in table.dataType.fields}
            missing = {"file", "seq"} - kinds.keys()
            if missing:
                raise ValueError(f"the table of an analysis needs {', '.join(sorted(missing))}")
            schema = T.StructType([T.StructField("file", kinds["file"]), *(T.StructField(n, T.StringType()) for n in ("check", "verdict", "detail")), T.StructField("value", T.DoubleType()), T.StructField("t", T.LongType())])
            return AnalyzeResult(schema, partitionBy=[PartitioningColumn("file")], orderBy=[OrderingColumn("seq")])

        def __init__(self):
            self.file, self.n, self.running, self.failed = None, 0, {}, {}
            for kind in checks:
                self.attempt(kind.name, lambda kind=kind: self.running.__setitem__(kind.name, kind()))

        def attempt(self, name, step):
            try:
                return step()
            except Exception as error:
                self.running.pop(name, None)
                self.failed[name] = f"{type(error).__name__}: {error}"

        def eval(self, row):
            self.file = row["file"]
            self.n += of is None or row["kind"] == of
            for name, check in list(self.running.items()):
                self.attempt(name, lambda check=check: check.see(row))

        def terminate(self):
            if self.n == 0:
                return
            for kind in checks:
                name = kind.name
                found = None
                if self.n >= least and name in self.running:
                    found = self.attempt(name, lambda name=name: self.whole(*self.running[name].finding()))
                if name in self.failed:
                    found = "ERROR", self.failed[name], None, None
                elif found is None:
                    found = "UNKNOWN", f"{self.n} rows of {least} needed", None, None
                yield (self.file, name, *found)

        @staticmethod
        def whole(verdict, detail, value, t):
            return str(verdict), None if detail is None else str(detail), None if value is None else float(value), None if t is None else int(t)

    return F.udtf(Run)(rows.asTable())


# ---- the four checks of positions -----------------------------------------------------------------


class Jumps(Check):
    """Steps between following points with a fix, held against the speed bounds of flight and of the ground until it is known which counts."""

    name = "position_jump"

    def __init__(self):
        self.last, self.fixes, self.most, self.top = None, 0, None, (0.0, None)
        self.counts = {speed: [0, 0] for speed in (telemetry.GROUND_SPEED, telemetry.FLIGHT_SPEED)}

    def see(self, row):
        if row["kind"] != "gps":
            return
        fix = row["status"] is not None and row["status"] >= 3
        self.fixes += fix
        if row["nsats"] is not None:
            self.most = max(row["nsats"], self.most or row["nsats"])
        here = (row["lat"], row["lon"], row["t"]) if fix else None
        before, self.last = self.last, here
        if here is None or before is None or None in here or None in before:
            return
        seconds = max((here[2] - before[2]) / 1e6, telemetry.LEAST_STEP)
        north = (here[0] - before[0]) * telemetry.DEGREE
        east = (here[1] - before[1]) * telemetry.DEGREE * math.cos(math.radians((here[0] + before[0]) / 2))
        way = math.sqrt(north * north + east * east)
        if way > self.top[0]:
            self.top = way, here[2]
        for speed, count in self.counts.items():
            if way > speed * seconds * telemetry.MULTIPLE:
                count[0] += 1
                count[1] += way > speed * telemetry.MULTIPLE

    def finding(self):
        flying = self.fixes >= 5 and self.most is not None and self.most > 4
        jumps, alerts = self.counts[telemetry.FLIGHT_SPEED if flying else telemetry.GROUND_SPEED]
        return "ALERT" if alerts else "SUSPICIOUS" if jumps else "CLEAN", f"{jumps} jumps, {alerts} of them far", *self.top


class Altitudes(Check):
    """How far altitude less that of the barometer nearest in time (`other`) strays from its mean over the first five fixes."""

    name = "alt_divergence"

    def __init__(self):
        self.rank, self.base, self.low, self.high = 0, [], None, None

    def see(self, row):
        if row["kind"] != "gps" or row["status"] is None or row["status"] < 3:
            return
        self.rank += 1
        if row["other"] is None or row["alt"] is None:
            return
        d = row["alt"] - row["other"]
        if self.rank <= 5:
            self.base.append(d)
        self.low, self.high = (d, d) if self.low is None else (min(d, self.low), max(d, self.high))

    def finding(self):
        if not self.base:
            return "UNKNOWN", "no barometer near the first fixes", None, None
        offset = sum(self.base) / len(self.base)
        most = max(self.high - offset, offset - self.low)
        return "ALERT" if most >= 20 else "SUSPICIOUS" if most >= 10 else "CLEAN", f"offset {offset:.1f} m", most, None


class Quality(Check):
    """Falls and rises of hdop and losses of satellites from one point to the next."""

    name = "gps_quality"

    def __init__(self):
        self.n, self.hdop, self.nsats, self.drop, self.spike, self.lost = 0, None, None, 0.0, 0.0, 0

    def see(self, row):
        if row["kind"] != "gps":
            return
        self.n += 1
        if self.hdop is not None and row["hdop"] is not None:
            h = row["hdop"] - self.hdop
            self.drop, self.spike = max(self.drop, -h if h < -1 else 0.0), max(self.spike, h if h > 2 else 0.0)
        if self.nsats is not None and row["nsats"] is not None:
            self.lost = max(self.lost, self.nsats - row["nsats"])
        self.hdop, self.nsats = row["hdop"], row["nsats"]

    def finding(self):
        bad = self.drop >= 1 and self.spike == 0 or self.spike >= 2 or self.lost >= 4
        verdict = "UNKNOWN" if self.n < 3 else "SUSPICIOUS" if bad else "CLEAN"
        return verdict, f"hdop -{self.drop:.1f} +{self.spike:.1f}, satellites -{self.lost}", None, None


class Innovation(Check):
    """Size of the estimator's innovation of velocity."""

    name = "ekf_innovation"

    def __init__(self):
        self.n, self.top = 0, (0.0, None)

    def see(self, row):
        if row["kind"] != "ekf":
            return
        self.n += 1
        if row["ivn"] is not None and row["ive"] is not None:
            size = math.sqrt(row["ivn"] * row["ivn"] + row["ive"] * row["ive"])
            if size > self.top[0]:
                self.top = size, row["t"]

    def finding(self):
        if self.n == 0:
            return "UNKNOWN", "no estimator rows", None, None
        return "ALERT" if self.top[0] > 10 else "SUSPICIOUS" if self.top[0] > 5 else "CLEAN", None, *self.top


SPOOF = [Jumps, Altitudes, Quality, Innovation]


def position_rows(gps: DataFrame, baro: DataFrame, ekf: DataFrame) -> DataFrame:
    """The rows that the four checks look at: kind, file, seq, t, and what each kind has; gps with the barometer nearest to each fix (`other`)."""
    points = gps.select("file", "seq", "t", "lat", "lon", "status", "nsats", "hdop", "alt")
    fixes = telemetry.nearest_in_time(points.where("status >= 3"), baro).drop("gap")
    rest = points.where("status is null or status < 3")
    tables = [fixes.withColumn("kind", F.lit("gps")), rest.withColumn("kind", F.lit("gps")), ekf.select("file", "seq", "t", "ivn", "ive", F.lit("ekf").alias("kind"))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def spoof_findings(gps: DataFrame, baro: DataFrame, ekf: DataFrame, more: list[type[Check]] | None = None) -> DataFrame:
    """As `telemetry.spoof_findings`, with detail, value and time, and checks of one's own beside the four."""
    return findings(position_rows(gps, baro, ekf), [*SPOOF, *(more or [])], least=5, of="gps")

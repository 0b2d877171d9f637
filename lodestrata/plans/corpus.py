"""A corpus of flight logs: an inventory row for each file, verdicts, summaries, selection and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import analyses, telemetry
from lodestrata.sources import dataflash
from lodestrata.sources.dataflash import field

#: Types whose rates are logged; subsystems of errors that mean something. Fixed values.
RATED = ["IMU", "ATT", "GPS", "BARO", "MAG", "RCIN", "MOTB"]
#: Error codes that an inventory row keeps; what is in the text of a message that names the firmware. Fixed values.
ERROR_CODES, VENDORS = 20, "ArduCopter|ArduPilot"
VOLTAGE, COMPASS, EKF, ARMING = 3, 6, 8, 10


def error_codes(records: DataFrame) -> DataFrame:
    """file, err_codes: subsystem and code of its first ERROR_CODES errors, in order."""
    errors = records.where("name = 'ERR'").select("file", "seq", field("Subsys", "SubSys", kind="long").alias("subsys"), field("ECode", kind="long").alias("ecode"))
    first = errors.withColumn("_i", F.row_number().over(telemetry.in_order())).where(F.col("_i") <= ERROR_CODES)
    return first.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "subsys", "ecode"))), lambda e: F.struct(e["subsys"].alias("subsys"), e["ecode"].alias("ecode"))).alias("err_codes"))


def rates(records: DataFrame) -> DataFrame:
    """file, logging_frequencies: the rate of each of the RATED types it has."""
    hz = telemetry.logging_frequency(records.where(F.col("name").isin(RATED) & (F.col("t") > 0)))
    return hz.groupBy("file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "hz")))).alias("logging_frequencies"))


def types_present(types: DataFrame) -> DataFrame:
    """file, message_types_present: names of the described types in order, but for that of descriptions."""
    return types.where("name <> 'FMT'").groupBy("file").agg(F.array_sort(F.collect_set("name")).alias("message_types_present"))


def inventory(records: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """A row for each file: duration, session, verdict and reasons, fingerprint, firmware, rates, first errors and the counts behind them.

    types: of `dataflash.read_types`, for the names of the types present. All counts come from one pass
    over the records; only orders within a file need windows. Records are read for each of these: those of
    `logscan` should be stored before, so that they are decoded once.
    """
    is_ = lambda *names: F.col("name").isin(*names)
    subsystem, code = field("Subsys", "SubSys", kind="long"), field("ECode", kind="long")
    status, sats, mode, event = field("Status", kind="long"), field("NSats", "Nsats", kind="long"), field("Mode", "ModeNum", kind="long"), field("Id", "ID", kind="long")
    error = is_("ERR")
    zero = lambda c: F.coalesce(c, F.lit(0))
    base = records.where("error is null").groupBy("file").agg(
        F.count_if(error).alias("err_count"), F.count_if(error & (subsystem == COMPASS) | is_("XKF4", "NKF4") & (field("SS", "Flags", kind="long").bitwiseAND(4) != 0)).alias("compass_warnings"),
        F.count_if(error & (subsystem == VOLTAGE) | is_("POWR") & (field("Vcc") < 4.5)).alias("voltage_alerts"), F.count_if(error & (subsystem == EKF)).alias("ekf_warnings"), F.count_if(error & (subsystem == ARMING) & (code > 0)).alias("arming_failures"),
        F.count_if(is_("EV") & (event == 15)).alias("armed"), F.count_if(is_("EV") & (event == 16)).alias("disarmed"),
        F.count_if(is_("GPS") & (status >= 3)).alias("fixes"), F.count_if(is_("GPS")).alias("statuses"), zero(F.max(F.when(is_("GPS"), status))).alias("top"), zero(F.max(F.when(is_("GPS"), sats))).alias("nsats_max"), F.coalesce(F.min(F.when(is_("GPS"), field("HDop", "Hdop"))), F.lit(99.99)).alias("hdop_min"),
        F.count_if(is_("BARO")).alias("baro_n"), zero(F.max(F.when(is_("BARO"), field("Alt"))) - F.min(F.when(is_("BARO"), field("Alt")))).alias("baro_range"),
        F.count_if(is_("MODE")).alias("modes"), F.count_if(is_("MODE") & mode.isin(telemetry.FLIGHT_MODES)).alias("flying"), F.count_if(is_("MODE") & mode.isin(telemetry.GROUND_MODES)).alias("ground"),
        F.count_if(is_("PARM")).alias("params"), zero(F.max(F.when(is_("MOTB"), field("ThO", "ThrOut")))).alias("max_throttle"), F.max_by(F.trim(field("Message", kind="string")), F.when(is_("MSG") & field("Message", kind="string").rlike(VENDORS), F.col("seq"))).alias("firmware_version"),
    )
    points = dataflash.gps(records)
    tables = [telemetry.session_duration(records), telemetry.gps_glitches(points), telemetry.position_changes(points), telemetry.config_fingerprint(dataflash.params(records)), error_codes(records), rates(records)]
    if types is not None:
        tables.append(types_present(types))
    for t in tables:
        base = base.join(t, "file", "left")
    c = F.col
    base = base.na.fill(0, ["glitches", "position_changes"]).na.fill("unknown", ["fingerprint", "firmware_version"]).withColumn("duration_s", c("duration_us") / 1e6)
    kind = telemetry.session_class(c("fixes"), c("nsats_max"), c("statuses"), c("top"), c("baro_n"), c("baro_range"), c("modes"), c("flying"), c("ground"))
    verdict, reasons = telemetry.usability(c("duration_s"), c("params"), {"err_count": c("err_count"), "gps_glitches": c("glitches"), "compass_warnings": c("compass_warnings"), "voltage_alerts": c("voltage_alerts"), "ekf_warnings": c("ekf_warnings"), "arming_failures": c("arming_failures")})
    found = base.withColumn("session_type", kind).withColumn("verdict", verdict).withColumn("reasons", reasons).withColumn("motor_test", c("max_throttle") > 0.05)
    broken = records.where("error is not null").select("file", F.lit("exclude").alias("verdict"), F.array(F.lit("no_schema")).alias("reasons"))
    return found.unionByName(broken, allowMissingColumns=True)


def selected(files: DataFrame, present: DataFrame, fingerprint: str | None = None, names: list[str] | None = None) -> DataFrame:
    """Rows of an inventory with the fingerprint and among the names, where given, whose file is present (file)."""
    if fingerprint is not None:
        files = files.where(F.col("fingerprint") == fingerprint)
    if names is not None:
        files = files.where(F.col("file").isin(names))
    return files.join(present.select("file"), "file", "left_semi")


def upper_median(column: str):
    """Element n // 2 of the sorted values, exactly."""
    return F.expr(f"percentile_disc(0.5) within group (order by {column} desc)")


def counted(files: DataFrame, column: str) -> DataFrame:
    """One row: the number of files by the values of a column, as a map."""
    counts = files.groupBy(F.coalesce(column, F.lit("unknown")).alias("k")).agg(F.count("*").alias("n"))
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(f"{column}_counts"))


def summary(files: DataFrame) -> DataFrame:
    """One row: total_files, verdict_counts, session_type_counts, median_hz, and of files with a duration their number (files), lo, hi, median.

    median_hz: by type, the upper median of its rates over files without anything against them, to one place.
    """
    clean = files.where("verdict = 'clean_baseline'").select(F.explode("logging_frequencies").alias("name", "hz"))
    hz = clean.groupBy("name").agg(F.round(upper_median("hz"), 1).alias("hz")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "hz")))).alias("median_hz"))
    known = F.col("duration_s").isNotNull()
    spans = files.agg(F.count("*").alias("total_files"), F.count_if(known).alias("files"), F.min("duration_s").alias("lo"), F.max("duration_s").alias("hi"), upper_median("duration_s").alias("median"))
    # one row each
    return spans.crossJoin(counted(files, "verdict")).crossJoin(counted(files, "session_type")).crossJoin(hz)


def by_fingerprint(files: DataFrame) -> DataFrame:
    """fingerprint, count and names of the files that have it, in order of the fingerprint."""
    return files.groupBy("fingerprint").agg(F.count("*").alias("count"), F.array_sort(F.collect_list("file")).alias("files")).orderBy("fingerprint")


def sink(results: DataFrame, path: str) -> None:
    """Write rows (an inventory, a summary, results) as JSON lines in a folder that doesn't exist yet."""
    results.write.json(path)


def analysis(records: DataFrame, more: list[type[analyses.Check]] | None = None) -> DataFrame:
    """file, verdict, confidence, findings (array of check and verdict) of every file with positions.

    more: checks of one's own beside the four, all of which are then run file by file; one that fails is an
    ERROR among the file's findings, and the verdict is that of the others.
    """
    tables = dataflash.gps(records), dataflash.baro(records), dataflash.ekf(records)
    findings = analyses.spoof_findings(*tables, more).select("file", "check", "verdict") if more else telemetry.spoof_findings(*tables)
    each = findings.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("check", "verdict"))).alias("findings"))  # four for each file
    return telemetry.weighted_verdict(findings).join(each, "file")


#: Analyses by name.
ANALYZERS = {"gps_spoof": analysis}


def analyzer(name: str):
    """The analysis of that name; ValueError if there is none."""
    if name not in ANALYZERS:
        raise ValueError(f"no analyzer {name!r}, there are: {', '.join(sorted(ANALYZERS))}")
    return ANALYZERS[name]


def analysis_summary(results: DataFrame) -> DataFrame:
    """One row for an analysis (file, verdict, confidence, findings): total_files, verdict_counts, confidence, alert_files, suspicious_files.

    confidence: the mean of those above 0, to three places, 0.0 without any.
    """
    named = lambda v: F.array_sort(F.collect_list(F.when(F.col("verdict") == v, F.col("file"))))
    mean = F.coalesce(F.round(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), 3), F.lit(0.0))
    found = results.agg(F.count("*").alias("total_files"), mean.alias("confidence"), named("ALERT").alias("alert_files"), named("SUSPICIOUS").alias("suspicious_files"))
    return found.crossJoin(counted(results, "verdict"))  # one row each


def report(results: DataFrame) -> DataFrame:
    """One line of text for each file of an analysis."""
    checks = F.array_join(F.transform("findings", lambda f: F.concat_ws("=", f["check"], f["verdict"])), ", ")
    return results.select("file", F.format_string("%-24s %-10s %5.3f  %s", F.col("file"), F.col("verdict"), F.col("confidence"), checks).alias("line"))

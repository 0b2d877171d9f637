"""Telemetry: durations, rates, state changes, jumps, nearest-in-time joins, verdicts and their summaries.

Tables are rows of (file, seq, ..), seq being the order within a file; every window is within a file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import upper_median

#: Parameters that make up a configuration. Fixed values.
SAFETY_PARAMS = [
    "ARMING_CHECK", "FS_THR_ENABLE", "FS_THR_VALUE", "FS_GCS_ENABLE", "FENCE_ENABLE", "FENCE_ACTION", "EKF_TYPE", "AHRS_EKF_TYPE",
    "MOT_SPIN_ARM", "MOT_SPIN_MIN", "COMPASS_USE", "COMPASS_AUTODEC", "GPS_TYPE", "GPS_GNSS_MODE", "BARO_PRIMARY", "INS_USE",
]
#: Modes of sustained flight, and those common on the ground. Fixed values.
FLIGHT_MODES, GROUND_MODES = [3, 4, 5, 6, 9, 10, 13, 14, 15, 16, 17, 18, 20, 21], [0, 1, 2]
#: Metres of a degree, seconds that a step takes at least, speeds on the ground and in flight, times the way at that speed. Fixed values.
DEGREE, LEAST_STEP, GROUND_SPEED, FLIGHT_SPEED, MULTIPLE = 111_320.0, 0.1, 0.5, 30.0, 5.0
#: Weight of each check in a verdict. Fixed values.
WEIGHTS = {"position_jump": 0.40, "alt_divergence": 0.25, "gps_quality": 0.20, "ekf_innovation": 0.15}


def in_order(*more: str) -> Window:
    return Window.partitionBy("file", *more).orderBy("seq")


def session_duration(records: DataFrame) -> DataFrame:
    """file, duration_us: the longest last-minus-first time, in order of seq, of a type with two records at least."""
    span = records.where("t is not null").groupBy("file", "name").agg((F.max_by("t", "seq") - F.min_by("t", "seq")).alias("d"), F.count("*").alias("n"))
    return span.where("n > 1").groupBy("file").agg(F.max("d").alias("duration_us"))


def logging_frequency(records: DataFrame) -> DataFrame:
    """file, name, hz: a million over the upper median of the positive gaps between following records."""
    gaps = records.withColumn("gap", F.lead("t").over(in_order("name")) - F.col("t")).where("gap > 0").withColumn("one", F.lit(1))
    return upper_median(gaps, ["file", "name"], "gap", "one").select("file", "name", (1e6 / F.col("median")).alias("hz"))


def gps_glitches(points: DataFrame) -> DataFrame:
    """file, glitches: fixes (status >= 3) regained after a loss (status <= 1) that followed a fix; status 2 changes nothing."""
    states = points.where("status >= 3 or status <= 1").withColumn("fix", F.col("status") >= 3)
    again = states.withColumn("was", F.lag("fix").over(in_order())).withColumn("had", F.max("fix").over(in_order().rowsBetween(Window.unboundedPreceding, -1)))
    return again.groupBy("file").agg(F.count_if(F.col("fix") & ~F.col("was") & F.col("had")).alias("glitches"))


def position_changes(points: DataFrame, least: float = 1e-5) -> DataFrame:
    step = F.abs(F.col("lat") - F.lag("lat").over(in_order()))
    return points.withColumn("step", step).groupBy("file").agg(F.count_if(F.col("step") > least).alias("position_changes"))


def is_flight(points: DataFrame, fixes: int = 5) -> DataFrame:
    """file, flight: `fixes` fixes at least, and more than 4 satellites once."""
    return points.groupBy("file").agg((F.count_if(F.col("status") >= 3).__ge__(fixes) & F.coalesce(F.max("nsats") > 4, F.lit(False))).alias("flight"))


def position_jumps(points: DataFrame) -> DataFrame:
    """file, steps, max_jump_m, max_jump_t, jumps, alerts, verdict, by distance between following points that both have a fix.

    A step further than 5 times the way at the speed bound is a jump; one further than 5 times the way of a
    second too is an alert.
    """
    before = lambda c: F.lag(c).over(in_order())
    names = ("lat", "lon", "status", "t")
    steps = points.select("file", "seq", *names, *(before(c).alias(f"_{c}") for c in names)).where("status >= 3 and _status >= 3")
    seconds = F.greatest((F.col("t") - F.col("_t")) / 1e6, F.lit(LEAST_STEP))
    north = (F.col("lat") - F.col("_lat")) * DEGREE
    east = (F.col("lon") - F.col("_lon")) * DEGREE * F.cos(F.radians((F.col("lat") + F.col("_lat")) / 2))
    steps = steps.withColumn("m", F.sqrt(north * north + east * east)).withColumn("s", seconds)
    speeds = is_flight(points).withColumn("speed", F.when(F.col("flight"), FLIGHT_SPEED).otherwise(GROUND_SPEED))
    found = steps.join(speeds, "file")
    jump = F.col("m") > F.col("speed") * F.col("s") * MULTIPLE
    alert = jump & (F.col("m") > F.col("speed") * 1.0 * MULTIPLE)
    out = found.groupBy("file").agg(F.count("*").alias("steps"), F.max("m").alias("max_jump_m"), F.min_by("t", F.struct(-F.col("m"), F.col("seq"))).alias("max_jump_t"), F.count_if(jump).alias("jumps"), F.count_if(alert).alias("alerts"))
    out = speeds.select("file").join(out, "file", "left").na.fill(0, ["steps", "jumps", "alerts"]).na.fill(0.0, ["max_jump_m"])
    return out.withColumn("verdict", F.when(F.col("alerts") > 0, "ALERT").when(F.col("jumps") > 0, "SUSPICIOUS").otherwise("CLEAN"))


def quality_shifts(points: DataFrame) -> DataFrame:
    """file, n, max_drop, max_spike, max_sat_drop, verdict: falls of hdop over 1, rises over 2, losses of satellites."""
    d = points.select("file", "seq", (F.col("hdop") - F.lag("hdop").over(in_order())).alias("h"), (F.col("nsats") - F.lag("nsats").over(in_order())).alias("s"))
    out = d.groupBy("file").agg(
        F.count("*").alias("n"),
        F.coalesce(F.max(F.when(F.col("h") < -1, -F.col("h"))), F.lit(0.0)).alias("max_drop"),
        F.coalesce(F.max(F.when(F.col("h") > 2, F.col("h"))), F.lit(0.0)).alias("max_spike"),
        F.greatest(F.coalesce(F.max(-F.col("s")), F.lit(0)), F.lit(0)).alias("max_sat_drop"),
    )
    bad = (F.col("max_drop") >= 1) & (F.col("max_spike") == 0) | (F.col("max_spike") >= 2) | (F.col("max_sat_drop") >= 4)
    return out.withColumn("verdict", F.when(F.col("n") < 3, "UNKNOWN").when(bad, "SUSPICIOUS").otherwise("CLEAN"))


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance: int = 2_000_000) -> DataFrame:
    """left (file, seq, t, ..) with the alt (named `other`) and distance `gap` of the right row nearest in t; null beyond the tolerance.

    Of rows at one time the first by seq counts, of rows equally near the earlier one.  Both sides are
    sorted together by file and time, once in either direction; each left row then takes the last right row
    before it: no pair is made, and the work is linear in the rows.
    """
    first = right.groupBy("file", "t").agg(F.min_by("alt", "seq").alias("alt"))
    both = left.select("file", "t", F.struct(*left.columns).alias("l"), F.lit(None).cast("struct<t:bigint,alt:double>").alias("r"))
    both = both.unionByName(first.select("file", "t", F.lit(None).cast(left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType).alias("l"), F.struct(F.col("t").cast("long").alias("t"), F.col("alt").cast("double").alias("alt")).alias("r")))
    # at equal times the right row is in view of both directions: windows are by range of t. Both run from their
    # beginning to the current row (the second one in falling order), which Spark keeps up row by row
    behind = F.last("r", ignorenulls=True).over(Window.partitionBy("file").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.last("r", ignorenulls=True).over(Window.partitionBy("file").orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    near = both.withColumn("b", behind).withColumn("a", ahead).where("l is not null")
    early, late = F.col("l.t") - F.col("b.t"), F.col("a.t") - F.col("l.t")
    use_back = F.col("a").isNull() | (F.col("b").isNotNull() & (early <= late))
    near = near.withColumn("gap", F.when(use_back, early).otherwise(late)).withColumn("other", F.when(use_back, F.col("b.alt")).otherwise(F.col("a.alt")))
    fits = F.col("gap") <= tolerance
    return near.select("l.*", F.when(fits, F.col("gap")).alias("gap"), F.when(fits, F.col("other")).alias("other"))


def altitude_divergence(points: DataFrame, baro: DataFrame, baseline: int = 5, tolerance: int = 2_000_000) -> DataFrame:
    """file, samples, offset_m, max_div_m, avg_div_m, verdict: fixes against the barometer and the mean offset of the first five."""
    fixes = points.where("status >= 3").withColumn("rank", F.row_number().over(in_order()))
    near = nearest_in_time(fixes.select("file", "seq", "t", "alt", "rank"), baro, tolerance).where("other is not null")
    offset = near.where(F.col("rank") <= baseline).groupBy("file").agg(F.avg(F.col("alt") - F.col("other")).alias("offset_m"))
    gaps = near.join(offset, "file").withColumn("d", F.abs(F.col("alt") - (F.col("other") + F.col("offset_m"))))
    out = gaps.groupBy("file").agg(F.count("*").alias("samples"), F.first("offset_m").alias("offset_m"), F.max("d").alias("max_div_m"), F.avg("d").alias("avg_div_m"))
    out = points.select("file").distinct().join(out, "file", "left").na.fill(0, ["samples"])
    return out.withColumn("verdict", F.when(F.col("samples") == 0, "UNKNOWN").when(F.col("max_div_m") >= 20, "ALERT").when(F.col("max_div_m") >= 10, "SUSPICIOUS").otherwise("CLEAN"))


def innovation(points: DataFrame) -> DataFrame:
    """file, n, max_mag, mean_mag, max_t (of the first largest), over_10, over_5, verdict; points: file, seq, t, ivn, ive."""
    p = points.withColumn("m", F.sqrt(F.col("ivn") * F.col("ivn") + F.col("ive") * F.col("ive")))
    out = p.groupBy("file").agg(F.count("*").alias("n"), F.max("m").alias("max_mag"), F.avg("m").alias("mean_mag"), F.min_by("t", F.struct(-F.col("m"), F.col("t"), F.col("seq"))).alias("max_t"), F.count_if(F.col("m") > 10).alias("over_10"), F.count_if(F.col("m") > 5).alias("over_5"))
    return out.withColumn("verdict", F.when(F.col("over_10") > 0, "ALERT").when(F.col("over_5") > 0, "SUSPICIOUS").otherwise("CLEAN"))


def config_fingerprint(params: DataFrame, names: list[str] | None = None) -> DataFrame:
    """file, fingerprint of the last value of each named parameter (file, seq, param, value): 8 digits of a sha256 of sorted k=v."""
    kept = params.where(F.col("param").isin(SAFETY_PARAMS if names is None else names))
    last = kept.groupBy("file", "param").agg(F.max_by("value", "seq").alias("value"))
    pair = F.concat_ws("=", "param", F.format_string("%.4f", F.col("value").cast("double")))
    return last.groupBy("file").agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(pair)), "|"), 256), 1, 8).alias("fingerprint"))


def session_class(fixes: Column, nsats: Column, statuses: Column, top_status: Column, baro_n: Column, baro_range: Column, modes: Column, flying_modes: Column, ground_modes: Column) -> Column:
    """flight, ground or unknown, from one file's aggregates (counts are 0, not null, where there is nothing)."""
    low = (statuses == 0) | (top_status <= 1)
    return (
        F.when((fixes > 5) & (nsats > 4), "flight").when((baro_n > 1) & (baro_range > 5), "flight").when((baro_n > 1) & (baro_range <= 2) & low, "ground")
        .when(flying_modes > 0, "flight").when((modes > 0) & (ground_modes == modes), "ground").when((statuses > 0) & low, "ground").otherwise("unknown")
    )


def usability(duration_s: Column, params: Column, indicators: dict[str, Column]) -> tuple[Column, Column]:
    """Verdict and its reasons; indicators in the order in which they are named."""
    short = F.coalesce(duration_s < 5, F.lit(False))
    any_ = reduce(lambda a, b: a | b, [c > 0 for c in indicators.values()])
    named = F.array_compact(F.array(*(F.when(c > 0, F.concat(F.lit(f"{k}="), c.cast("string"))) for k, c in indicators.items())))
    flags = F.array_compact(F.array(F.when(params == 0, "no_parm_records"), F.when(F.coalesce(duration_s < 30, F.lit(False)), "short_duration")))
    verdict = F.when(short, "exclude").when(any_, "contains_deviations").when(F.size(flags) > 0, "review").otherwise("clean_baseline")
    reasons = F.when(short, F.array(F.lit("duration_too_short"))).when(any_, named).otherwise(flags)
    return verdict, reasons


def weighted_verdict(findings: DataFrame) -> DataFrame:
    """file, verdict, confidence from findings (file, check, verdict): the worst, and the weight of known checks raised by their scores."""
    weight = F.create_map(*(x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))))
    score = F.when(F.col("verdict") == "ALERT", 2).when(F.col("verdict") == "SUSPICIOUS", 1).when(F.col("verdict") == "CLEAN", 0)
    f = findings.withColumn("score", score).withColumn("w", F.when(F.col("score").isNotNull(), weight[F.col("check")]))
    out = f.groupBy("file").agg(F.max("score").alias("worst"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("score")).alias("ws"))
    confidence = F.when(F.col("w").isNotNull(), F.least(F.least("w", F.lit(1.0)) * (0.5 + 0.5 * F.col("ws") / F.col("w")), F.lit(1.0)))
    verdict = F.when(F.col("worst") == 2, "ALERT").when(F.col("worst") == 1, "SUSPICIOUS").when(F.col("worst") == 0, "CLEAN").otherwise("UNKNOWN")
    return out.select("file", verdict.alias("verdict"), F.coalesce(confidence, F.lit(0.0)).alias("confidence"))


def threshold_sweep(peaks: DataFrame, low: float = 0.1, high: float = 15.0, n: int = 500) -> DataFrame:
    """threshold, tpr, fpr for n even thresholds; peaks: (peak, attack boolean). The thresholds are a fixed list, exploded per distinct peak."""
    counted = peaks.groupBy("peak", "attack").agg(F.count("*").alias("c"))
    cuts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("i"), (F.lit(low) + i * F.lit(high - low) / F.lit(float(n - 1))).alias("threshold")))
    each = counted.select("peak", "attack", "c", F.explode(cuts).alias("x"))
    over = F.when(F.col("peak") > F.col("x.threshold"), F.col("c")).otherwise(0)
    rate = lambda side: F.sum(F.when(side, over)) / F.sum(F.when(side, F.col("c")))
    return each.groupBy(F.col("x.i").alias("i"), F.col("x.threshold").alias("threshold")).agg(rate(F.col("attack")).alias("tpr"), rate(~F.col("attack")).alias("fpr"))


def spoof_findings(gps: DataFrame, baro: DataFrame, ekf: DataFrame) -> DataFrame:
    """(file, check, verdict) of the four checks for files with five GPS points; other files get one UNKNOWN of each."""
    enough = gps.groupBy("file").agg((F.count("*") >= 5).alias("enough"))
    checks = {"position_jump": position_jumps(gps), "alt_divergence": altitude_divergence(gps, baro), "gps_quality": quality_shifts(gps), "ekf_innovation": innovation(ekf)}
    tables = [enough.join(t.select("file", F.col("verdict")), "file", "left").select("file", F.lit(k).alias("check"), F.when(F.col("enough"), F.coalesce("verdict", F.lit("UNKNOWN"))).otherwise("UNKNOWN").alias("verdict")) for k, t in checks.items()]
    return reduce(DataFrame.unionByName, tables)


def analysis_summary(findings: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files and mean positive confidence per verdict; counts of verdicts per check."""
    by_verdict = verdicts.groupBy("verdict").agg(F.count("*").alias("files"), F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))).alias("confidence"))
    return by_verdict, findings.groupBy("check").pivot("verdict", ["CLEAN", "SUSPICIOUS", "ALERT", "UNKNOWN"]).count().na.fill(0)

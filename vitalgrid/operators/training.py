"""Training load: session impulse, zone load, daily sums, acute and chronic load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid import config as C
from vitalgrid.functions import scan
from vitalgrid.functions.clock import dense, local_day, seconds
from vitalgrid.functions.impulse import banister, clamp, reserve, weight, zone_weight
from vitalgrid.operators.stress import beside, subject_of


def rest_by_day(days: DataFrame, resting: DataFrame, span: int = C.REST_WINDOW) -> DataFrame:
    """(subject, day, rest) for each of ``days``: the median resting rate of its last ``span`` calendar days, its own included.

    A band join by buckets of a day: each day asks for the ``span`` days before it, an equi join on (subject, day).
    """
    key = subject_of(days, resting)
    own = days.select(*key, "day").distinct()
    asked = own.select(*key, "day", F.explode(F.sequence(F.date_sub("day", span - 1), F.col("day"))).alias("_day"))
    values = resting.select(*key, F.col("day").alias("_day"), F.col("value").alias("_v"))
    return asked.join(values, [*key, "_day"], "left").groupBy(*key, "day").agg(F.percentile("_v", 0.5).alias("rest"))


def session_impulse(workouts: DataFrame, hr: DataFrame, resting: DataFrame, zone: str, hr_max: float | None = None, since=None) -> DataFrame:
    """(hae_id, day, trimp) of each session with a start, a ``subject`` at a time if the tables have that column: Banister impulse over its
    samples, each interval credited to its first sample and all rescaled to the session's length; without samples from the average rate; else 0.

    The maximum is the given one, else the largest session maximum within 160 and 210; rest is the 28-day median, else the overall one, else 60.
    """
    key = subject_of(workouts, hr, resting)
    most = F.lit(float(hr_max)) if hr_max is not None else F.col("_most")
    seen = workouts.groupBy(*key).agg(F.coalesce(clamp(F.max("max_hr"), C.HR_MAX_LOW, C.HR_MAX_HIGH), F.lit(C.HR_MAX_LOW)).alias("_most"))
    usual = resting.groupBy(*key).agg(F.percentile("value", 0.5).alias("_rest"))
    params = seen.join(usual, key, "left") if key else seen.crossJoin(usual)  # one row (a subject)
    base = workouts.filter("start_time is not null").withColumn("day", local_day(F.col("start_time"), zone))
    if since is not None:
        base = base.filter(F.col("day") >= F.lit(since))
    base = beside(base.join(rest_by_day(base, resting), [*key, "day"], "left"), params, key).withColumn("_r", F.coalesce("rest", "_rest", F.lit(C.REST_DEFAULT)))
    after = F.lead("ts").over(Window.partitionBy(*key, "workout_hae_id").orderBy("ts"))
    steps = hr.withColumn("_sec", seconds(after, F.col("ts"))).filter("_sec > 0").join(base.select(*key, F.col("hae_id").alias("workout_hae_id"), "_r", "_most"), [*key, "workout_hae_id"])
    share = reserve(F.col("bpm"), F.col("_r"), most)
    sums = steps.groupBy(*key, F.col("workout_hae_id").alias("hae_id")).agg(F.sum(F.col("_sec") / 60.0 * share * weight(share)).alias("_raw"), F.sum("_sec").alias("_total"))
    average = reserve(F.col("avg_hr"), F.col("_r"), most)
    by_average = F.col("duration_s") / 60.0 * average * weight(average)
    by_samples = F.col("_raw") * F.when(F.col("duration_s") > 0, F.col("duration_s") / F.col("_total")).otherwise(F.lit(1.0))
    return base.join(sums, [*key, "hae_id"], "left").select(*key, "hae_id", "day", F.coalesce(by_samples, by_average, F.lit(0.0)).alias("trimp"))


def daily_impulse(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy(*subject_of(sessions), "day").agg(F.sum("trimp").alias("trimp"))


def edwards(workouts: DataFrame, hr: DataFrame, hr_max: float) -> DataFrame:
    """(hae_id, edwards): minutes times the zone of each interval's first sample, rescaled to the session; 0 with fewer than two samples."""
    after = F.lead("ts").over(Window.partitionBy("workout_hae_id").orderBy("ts"))
    steps = hr.withColumn("_sec", F.greatest(F.lit(0.0), F.coalesce(seconds(after, F.col("ts")), F.lit(0.0))))
    sums = steps.groupBy(F.col("workout_hae_id").alias("hae_id")).agg(F.count(F.lit(1)).alias("_n"), F.sum("_sec").alias("_total"), F.sum(F.col("_sec") / 60.0 * zone_weight(F.col("bpm"), F.lit(hr_max))).alias("_raw"))
    scale = F.when(F.col("duration_s") > 0, F.try_divide(F.col("duration_s"), F.col("_total"))).otherwise(F.lit(1.0))
    value = F.when((F.col("_n") >= 2) & (F.col("_total") > 0), F.col("_raw") * scale).otherwise(F.lit(0.0))
    return workouts.select("hae_id", "duration_s").join(sums, "hae_id", "left").select("hae_id", F.coalesce(value, F.lit(0.0)).alias("edwards"))


def workout_daily(workouts: DataFrame, zone_loads: DataFrame, rest: DataFrame, zone: str, rest_default: float, hr_max: float, sex: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Sums of trimp, energy load, zone load, hours and count by day (and ``by``), and the plain mean of intensity."""
    df = workouts.filter("start_time is not null").withColumn("day", local_day(F.col("start_time"), zone)).join(rest, "day", "left").join(zone_loads, "hae_id", "left")
    trimp = banister(F.col("duration_s"), F.col("avg_hr"), F.coalesce("rest", F.lit(rest_default)), F.lit(hr_max), sex)
    return df.groupBy("day", *(by or [])).agg(
        F.sum(trimp).alias("trimp"), F.sum(F.coalesce("active_energy_kcal", F.lit(0.0))).alias("load"), F.sum(F.coalesce("edwards", F.lit(0.0))).alias("edwards"),
        F.sum(F.coalesce("duration_s", F.lit(0.0)) / 3600.0).alias("duration_h"), F.count(F.lit(1)).alias("count"), F.avg("intensity").alias("intensity"),
    )


def resolve_hr_max(profile: C.Profile, observed: Column, as_of_year: int | None = None) -> Column:
    """The given maximum, else 208 - 0.7 age, else the observed one within 160 and 210, else 190."""
    if profile.hr_max is not None:
        return F.lit(float(profile.hr_max))
    if profile.age is not None:
        return F.lit(208 - 0.7 * profile.age)
    return F.when(observed.isNotNull(), clamp(observed, C.HR_MAX_LOW, C.HR_MAX_HIGH)).otherwise(F.lit(C.HR_MAX_DEFAULT))


def rolling_rest(resting: DataFrame) -> DataFrame:
    """(day, rest): 28-day median on the dense grid where seven values are there, else null."""
    return rolling_rest_of(resting.withColumn("series", F.lit("rest"))).select("day", "rest")


def rolling_rest_of(resting: DataFrame) -> DataFrame:
    """The same of each ``series``: (series, day, rest)."""
    grid = dense(resting.select("series", "day", "value"), ["series"])
    w = Window.partitionBy("series").orderBy("day").rowsBetween(1 - C.REST_WINDOW, 0)
    return grid.select("series", "day", F.when(F.count("value").over(w) >= C.REST_MIN, F.percentile("value", 0.5).over(w)).alias("rest"))


def load_by_group(workouts: DataFrame, groups: DataFrame, zone: str) -> DataFrame:
    """Hours, distance and sessions by week and display group."""
    df = workouts.filter("start_time is not null").join(F.broadcast(groups), "canonical_type", "left").withColumn("display_group", F.coalesce("display_group", F.lit("Other")))
    week = F.to_date(F.date_trunc("week", local_day(F.col("start_time"), zone)))
    far = [F.sum("distance_km").alias("distance_km")] if "distance_km" in workouts.columns else []
    return df.groupBy(week.alias("week"), "display_group").agg(F.sum(F.col("duration_s") / 3600.0).alias("hours"), *far, F.count(F.lit(1)).alias("sessions"))


def load_focus(workouts: DataFrame, hr: DataFrame, zone: str, hr_max: float) -> DataFrame:
    """Minutes a day at 50 to 80, 80 to 90 and from 90 % of the maximum, by samples where there are any, else by the average rate."""
    after = F.lead("ts").over(Window.partitionBy("workout_hae_id").orderBy("ts"))
    base = workouts.filter("start_time is not null").select("hae_id", "duration_s", "avg_hr", local_day(F.col("start_time"), zone).alias("day"))
    steps = hr.withColumn("sec", seconds(after, F.col("ts"))).filter("sec > 0").select(F.col("workout_hae_id").alias("hae_id"), "bpm", "sec")
    plain = base.join(steps.select("hae_id").distinct(), "hae_id", "left_anti").select("day", F.col("avg_hr").alias("bpm"), F.col("duration_s").alias("sec"))
    both = base.select("hae_id", "day").join(steps, "hae_id").select("day", "bpm", "sec").unionByName(plain)
    share = F.col("bpm") / hr_max
    minutes = lambda on: F.sum(F.when(on, F.col("sec") / 60.0).otherwise(F.lit(0.0)))
    return both.groupBy("day").agg(minutes((share >= 0.5) & (share < 0.8)).alias("low_min"), minutes((share >= 0.8) & (share < 0.9)).alias("high_min"), minutes(share >= 0.9).alias("peak_min"))


def acwr_history(loads: DataFrame) -> DataFrame:
    """(series, day, acute, chronic, ratio) on dense loads, from the 28th day on where the chronic mean is positive."""
    w = Window.partitionBy("series").orderBy("day")
    mean = lambda n: F.avg("value").over(w.rowsBetween(1 - n, 0))
    df = loads.select("series", "day", mean(C.ACUTE_DAYS).alias("acute"), mean(C.CHRONIC_DAYS).alias("chronic"), F.row_number().over(w).alias("_n"))
    return df.filter((F.col("_n") >= C.CHRONIC_DAYS) & (F.col("chronic") > 0)).select("series", "day", "acute", "chronic", (F.col("acute") / F.col("chronic")).alias("ratio"))


def smoothed(loads: DataFrame, block: int = 32) -> DataFrame:
    """(series, day, value, ctl, atl): exponential smoothing from zero, y += (x - y) / tau, of each dense series.

    A linear scan by blocks of days: from a start y, a block of n days ends at (1 - 1/tau)^n y plus what it gives from zero. Block ends are
    folded along each series (twelve or so a year), then each block is walked from its start, all in arrays in the JVM.
    """
    taus = {"ctl": float(C.CTL_TAU), "atl": float(C.ATL_TAU)}
    step = lambda y, x, tau: y + (x - y) / F.lit(tau)
    both = lambda y, x: F.struct(*[step(y[k], x["value"], tau).alias(k) for k, tau in taus.items()])
    zero = F.struct(*[F.lit(0.0).alias(k) for k in taus])
    kind = "struct<ctl:double,atl:double>"
    held = loads.select("series", "day", F.col("value").cast("double").alias("value"), F.floor(F.unix_date("day") / block).alias("_block"))
    held = held.groupBy("series", "_block").agg(F.array_sort(F.collect_list(F.struct("day", "value"))).alias("_days"))
    ends = held.select("series", F.struct("_block", F.size("_days").alias("n"), F.aggregate("_days", zero, both).alias("end")).alias("_b"))
    ends = ends.groupBy("series").agg(F.array_sort(F.collect_list("_b")).alias("_all"))
    onward = lambda y, x: F.struct(*[(y[k] * F.pow(F.lit(1 - 1 / tau), x["n"]) + x["end"][k]).alias(k) for k, tau in taus.items()])
    starts = scan.fold(F.col("_all"), zero, f"struct<_block:bigint,y:{kind}>", onward, lambda y, x: F.struct(x["_block"].alias("_block"), y.alias("y")))
    starts = ends.select("series", F.explode(starts).alias("_s")).select("series", "_s.*")
    path = scan.fold(F.col("_days"), F.col("y"), f"struct<day:date,value:double,y:{kind}>", both, lambda y, x: F.struct(x["day"].alias("day"), x["value"].alias("value"), both(y, x).alias("y")))
    return held.join(starts, ["series", "_block"]).select("series", F.explode(path).alias("_p")).select("series", "_p.day", "_p.value", "_p.y.ctl", "_p.y.atl")


def training_status(path: DataFrame, c: C.Load = C.Load()) -> DataFrame:
    """(series, day, ctl, atl, tsb, tsb_pct, zone, ctl_ago, ctl_trend) at each series' last day, from 42 days of positive chronic load on."""
    w = Window.partitionBy("series").orderBy(F.desc("day"))
    df = path.withColumns({"_rn": F.row_number().over(w), "_n": F.count(F.lit(1)).over(Window.partitionBy("series")), "ctl_ago": F.lead("ctl", C.CTL_LOOKBACK).over(w)})
    df = df.filter(F.col("_rn") == 1).filter((F.col("_n") >= C.CTL_TAU) & (F.col("ctl") > 0))
    df = df.withColumns({"tsb": F.col("ctl") - F.col("atl"), "tsb_pct": (F.col("ctl") - F.col("atl")) / F.col("ctl")})
    p, rel = F.col("tsb_pct"), F.try_divide("ctl", "ctl_ago") - 1.0
    zone = F.when(p >= c.detraining, "detraining").when(p >= c.fresh, "fresh").when(p > -c.fresh, "neutral").when(p > c.overreach, "productive").otherwise("overreaching_risk")
    trend = F.when(F.col("ctl_ago").isNull(), F.lit(None)).when(F.col("ctl_ago") <= 0, F.when(F.col("ctl") > 0, "rising").otherwise("flat")).when(rel >= C.CTL_REL, "rising").when(rel <= -C.CTL_REL, "falling").otherwise("flat")
    return df.select("series", "day", "ctl", "atl", "tsb", "tsb_pct", zone.alias("zone"), "ctl_ago", trend.alias("ctl_trend"))


def active_days(loads: DataFrame, days: int = C.CHRONIC_DAYS) -> DataFrame:
    w = Window.partitionBy("series").orderBy(F.desc("day"))
    return loads.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= days).groupBy("series").agg(F.count_if(F.col("value") > 0).alias("active_days"))

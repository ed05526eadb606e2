"""The runs over stored tables: stress pass, energy pass, short refresh, and the whole analysis from samples to findings."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid import config as C
from vitalgrid.functions.tables import kept
from vitalgrid.operators import daily, decompose, energy, findings, robust, series, sleep, stress, training
from vitalgrid.operators.stress import beside, subject_of
from vitalgrid.sources import merge


def _bounded(rows: DataFrame, bounds: DataFrame, early_days: int = 0, ts: str = "ts") -> DataFrame:
    """``rows`` of [start, end), and of ``early_days`` more before; bounds are a row (a subject)."""
    key = subject_of(rows, bounds)
    own = bounds.select(*key, (F.col("start") - F.expr(f"interval {24 * early_days} hours")).alias("_from"), F.col("end").alias("_to"))
    return beside(rows, own, key).filter((F.col(ts) >= F.col("_from")) & (F.col(ts) < F.col("_to"))).select(*rows.columns)


def _meeting(intervals: DataFrame, bounds: DataFrame) -> DataFrame:
    """``intervals`` that meet [start, end) of their subject's bounds, before anything is merged."""
    key = subject_of(intervals, bounds)
    own = bounds.select(*key, F.col("start").alias("_from"), F.col("end").alias("_to"))
    return beside(intervals, own, key).filter((F.col("end") >= F.col("_from")) & (F.col("start") < F.col("_to"))).select(*intervals.columns)


def _vitals(samples: DataFrame, zone: str) -> DataFrame:
    """(day, metric, value): the daily values the stress pass needs, in one scan."""
    kinds = {"resting_heart_rate": F.avg(F.coalesce("vavg", "qty")), "heart_rate_variability": F.avg(F.coalesce("vavg", "qty")), "heart_rate": F.max(F.coalesce("vmax", "qty"))}
    own = samples.filter(F.col("metric").isin(*kinds)).withColumn("day", daily.local_day(F.col("time"), zone))
    picked = F.when(F.col("metric") == "heart_rate", kinds["heart_rate"]).otherwise(kinds["resting_heart_rate"])
    return own.groupBy(*subject_of(samples), "day", "metric").agg(picked.alias("value")).filter("value is not null")


def _scored(values: DataFrame) -> DataFrame:
    """(day, hrv_z) against the trailing window, a subject at a time."""
    key = subject_of(values)
    name = F.col("subject").cast("string") if key else F.lit("hrv")
    z = robust.robust_z(values.select(name.alias("series"), "day", "value")).select(F.col("series").alias("_s"), F.col("day").alias("_d"), F.col("z").alias("hrv_z"))
    return values.join(z, (name == F.col("_s")) & (F.col("day") == F.col("_d"))).select(*key, "day", "hrv_z")


def _resting(values: DataFrame) -> DataFrame:
    """(day, rest): the rolling median of each day that has any."""
    key = subject_of(values)
    own = values.withColumn("series", F.col("subject").cast("string") if key else F.lit("rest"))
    rest = training.rolling_rest_of(own)
    return rest.join(own.select(*key, "series").distinct(), "series").select(*key, "day", "rest") if key else rest.select("day", "rest")


def stress_pass(samples: DataFrame, workouts: DataFrame, c: C.Config, since_days: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(buckets, days) of the window that ends at the newest heart rate: ``since_days`` local days, or everything.

    Baselines come from all of history, so a short window gives the rows of a long one: resting rate by the 28-day median, else the profile's,
    else the overall median, else 60; variability as a trailing score; the maximum by the profile, age or the data. Steps gate activity only
    where they come about by the minute. Days with too little measured are left out, and so is everything where the pass is off.
    """
    hr = kept(stress.intraday_hr(samples), "hr")
    key = subject_of(samples, workouts)
    vitals = kept(_vitals(samples, c.zone), "vitals")  # a row a day and metric
    daily_value = lambda metric: vitals.filter(F.col("metric") == metric).drop("metric")
    bounds = stress.window_bounds(hr, c.zone, since_days)
    rest_values = daily_value("resting_heart_rate")
    seen = daily_value("heart_rate").groupBy(*key).agg(F.max("value").alias("_seen"))
    usual = rest_values.groupBy(*key).agg(F.percentile("value", 0.5).alias("_usual"))
    params = bounds.join(seen, key, "left").join(usual, key, "left") if key else bounds.crossJoin(seen).crossJoin(usual)  # a row each
    given = F.lit(c.profile.hr_rest).cast("double") if c.profile.hr_rest is not None else F.lit(None).cast("double")
    params = params.select(*key, training.resolve_hr_max(c.profile, F.col("_seen")).alias("_max"), F.coalesce(given, "_usual", F.lit(C.REST_DEFAULT)).alias("_default"))
    window = _bounded(hr, bounds)
    window = beside(window, params, key)
    steps = kept(_bounded(stress.intraday_steps(samples), bounds), "steps")
    fine = stress.cadence_is_fine(steps).filter("fine").select(*key, "fine")
    steps = beside(steps, fine, key).select(*steps.columns)
    hrv_z = _scored(daily_value("heart_rate_variability"))
    buckets = stress.timeline(window, _resting(rest_values), hrv_z, _meeting(stress.workout_intervals(workouts), bounds), steps, c.zone, c.stress, F.col("_max"), F.col("_default"))
    buckets = kept(buckets if c.stress.enabled else buckets.limit(0), "buckets")
    days = stress.stored_daily(stress.daily(buckets), c.stress)
    return buckets, days.join(hrv_z.withColumn("hrv_z", F.round("hrv_z", 4)), [*key, "day"], "left")


def neutral_level(buckets: DataFrame, asleep: DataFrame, e: C.Energy) -> DataFrame:
    """(neutral): the set level, else the one the last 60 days show, else 25; a row (a subject)."""
    key = subject_of(buckets, asleep)
    if e.neutral is not None:
        return buckets.groupBy(*key).agg(F.lit(float(e.neutral)).alias("neutral"))
    return energy.auto_neutral(buckets, asleep)


def energy_pass(buckets: DataFrame, asleep: DataFrame, c: C.Config, since_days: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(levels, days) of the window from stored stress ``buckets`` and sleep intervals (start, end, efficiency).

    A window of ``since_days`` integrates seven days more before it, which only settle the level. Days with too few telling buckets have levels,
    but no row of their own. Levels are whole numbers, rounded half-even.
    """
    key = subject_of(buckets, asleep)
    bounds = stress.window_bounds(buckets, c.zone, since_days)
    warm = _bounded(buckets, bounds, C.WARM_UP_DAYS if since_days is not None else 0)
    neutral = neutral_level(buckets, asleep, c.energy)
    warm = beside(warm, neutral, key)
    levels = _bounded(energy.integrate(energy.rates(warm, asleep, F.col("neutral"), c.energy), c.energy.seed), bounds)
    if not c.energy.enabled:
        levels = levels.limit(0)
    days = energy.daily(levels, energy.wake_ends(asleep, c.zone), c.zone).join(energy.informative_days(warm, c.zone, c.energy.min_measured), [*key, "day"])
    whole = lambda name: F.rint(name).cast("int").alias(name)
    return levels.select(*key, "ts", whole("level")), days.select(*key, "day", *[whole(x) for x in ("wake_level", "high_level", "low_level", "charged", "drained")])


def refresh(read: Callable[[str], DataFrame], c: C.Config, root: str, since_days: int | None = 2) -> dict[str, int]:
    """Both passes over a short window, each table's days of that window replaced: stress_intraday, stress_daily, battery_intraday and
    battery_daily under ``root``, partitioned by day. Running it again changes nothing. Returns the days stored. One subject's tables only.
    """
    samples, workouts = read("metric_samples"), read("workouts")
    spark = samples.sparkSession
    hr = stress.intraday_hr(samples)
    bounds = stress.window_bounds(hr, c.zone, since_days).first()
    if bounds is None:
        return {"stress": 0, "battery": 0}
    last = hr.agg(F.max(daily.local_day(F.col("ts"), c.zone))).first()[0]

    def table(name: str, like: DataFrame) -> DataFrame:  # its schema is given: it may be empty
        merge.complete(spark, f"{root}/{name}")
        return spark.read.schema(like.schema).parquet(f"{root}/{name}")

    def put(name: str, rows: DataFrame) -> int:
        merge.replace_window(f"{root}/{name}", rows, "day", bounds["first_day"], last)
        return table(name, rows).filter(F.col("day").between(bounds["first_day"], last)).count()

    buckets, days = stress_pass(samples, workouts, c, since_days)
    put("stress_intraday", buckets)
    done = {"stress": put("stress_daily", days)}
    early = bounds["start"] - timedelta(days=C.WARM_UP_DAYS if since_days is not None else 0)
    stored = stress.stored(table("stress_intraday", buckets), early, bounds["end"]).drop("day").withColumn("day", daily.local_day(F.col("ts"), c.zone))
    levels, days = energy_pass(stored, read("sleep_intervals"), c, since_days)
    put("battery_intraday", levels.withColumn("day", daily.local_day(F.col("ts"), c.zone)))
    return done | {"battery": put("battery_daily", days)}


def all_series(samples: DataFrame, registry: DataFrame, nights: DataFrame, by_day: DataFrame, by_type: DataFrame, c: C.Config) -> DataFrame:
    """Core metrics, sleep and workout loads in one long frame."""
    return series.core(samples, registry, c.zone).unionByName(series.sleep(nights)).unionByName(series.workouts(by_day, by_type, c.load.metric, c.load.edwards))


def loads(workouts: DataFrame, hr: DataFrame, resting: DataFrame, c: C.Config) -> tuple[DataFrame, DataFrame]:
    """Daily load sums of all sessions, and by type. Maximum and resting rate follow the profile, then the data, then fixed values."""
    ends = workouts.agg(F.max("max_hr").alias("_seen")).crossJoin(resting.agg(F.percentile("value", 0.5).alias("_usual")))
    given = F.lit(c.profile.hr_rest).cast("double")
    one = ends.select(training.resolve_hr_max(c.profile, F.col("_seen")).cast("double").alias("most"), F.coalesce(given, "_usual", F.lit(C.REST_DEFAULT)).alias("rest")).first()
    zones, rest = training.edwards(workouts, hr, one["most"]), training.rolling_rest(resting)
    daily_of = lambda by: training.workout_daily(workouts, zones, rest, c.zone, one["rest"], one["most"], c.profile.sex, by)
    return daily_of(None), daily_of(["canonical_type"])


def analyze(read: Callable[[str], DataFrame], c: C.Config, root: str, written: Callable[[DataFrame, str], DataFrame], computed_at) -> dict[str, str]:
    """The whole analysis of one subject's stored tables: series, the snapshot of load series, both passes, all kinds of findings, snapshot and
    history of them under ``root``. Returns what went wrong with any part; the others are stored all the same.
    """
    samples, registry, workouts = read("metric_samples"), read("metric_registry"), read("workouts")
    sessions = read("sleep_sessions").withColumn("id", F.xxhash64("sleep_end", "source"))
    nights = sleep.frame(sleep.nightly(sessions), c.zone)
    resting = series.core(samples, registry.filter("metric = 'resting_heart_rate'"), c.zone)
    by_day, by_type = loads(workouts, read("workout_hr_samples"), resting, c)
    values = written(all_series(samples, registry, nights, by_day, by_type, c), "all_series")
    failed: dict[str, str] = {}

    def contained(name: str, part: Callable):
        try:
            return part()
        except Exception as e:  # one part's fault stops no other
            failed[name] = f"{type(e).__name__}: {e}"[:500]

    stamp = F.lit(computed_at).cast("timestamp").alias("computed_at")
    contained("workout_load_daily", lambda: values.filter("series like 'workout\\_%' and value is not null").select("series", "day", "value", stamp).write.mode("overwrite").parquet(f"{root}/workout_load_daily"))
    done = contained("refresh", lambda: refresh(lambda n: sleep.intervals(sessions) if n == "sleep_intervals" else read(n), c, root, c.stress.window_days)) or {}
    days = {k: samples.sparkSession.read.parquet(f"{root}/{k}_daily") if done.get(k) else None for k in ("stress", "battery")}
    offset = nights.select(F.lit("bedtime").alias("series"), "day", sleep.bedtime_offset(F.col("bedtime")).alias("value"))
    length = nights.select(F.lit("sleep_total_h").alias("series"), "day", F.col("sleep_total_h").alias("value"))
    found, more = run(values, sleep.regularity(length.unionByName(offset), c.consistency.window), c, written, days["stress"], days["battery"])
    if found is not None:
        findings.store(found, f"{root}/findings", f"{root}/findings_history", computed_at)
    return failed | more


def run(values: DataFrame, regular: DataFrame, c: C.Config, written: Callable[[DataFrame, str], DataFrame], stress_days: DataFrame | None = None, energy_days: DataFrame | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """All ten kinds of findings from the analysis series (series, day, value), the regularity of sleep, and the stored days of both passes.

    Series and their decomposition are written once and read by each kind; what goes wrong with one kind is reported beside the others' rows.
    """
    values = written(values, "series")
    parts = written(decompose.decompose(values), "parts")
    loads = daily.gaps_as_zero(values.filter(F.col("series").rlike("^workout_(trimp|load)")))
    kinds: dict[str, Callable[[], DataFrame]] = {
        "correlation": lambda: findings.correlations(decompose.residuals(parts), values, decompose.detrended(parts), c.correlation),
        "anomaly": lambda: findings.anomalies(values, c.anomaly), "trend": lambda: findings.trends(parts, c.shape), "seasonality": lambda: findings.seasons(parts, c.shape),
        "recovery_alert": lambda: findings.recovery(values, c.recovery), "consistency": lambda: findings.consistency(regular, c.consistency),
        "training_load": lambda: findings.training_load(findings.load_targets(loads), c.load), "training_status": lambda: findings.training_status(loads, c.load),
    }
    if stress_days is not None and c.stress.enabled:
        kinds["stress"] = lambda: findings.stress_alerts(stress.recent(stress_days, c.stress.recent_days), c.stress)
    if energy_days is not None and c.energy.enabled:
        kinds["body_battery"] = lambda: findings.energy_alerts(stress.recent(energy_days, c.energy.recent_days), c.energy)
    return findings.collect_kinds(kinds, written)

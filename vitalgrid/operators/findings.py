"""Findings of ten kinds in one schema, each from its own frame, and the feed that shows them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid import config as C
from vitalgrid.operators import correlation as K
from vitalgrid.operators import decompose as D
from vitalgrid.operators import robust, training

COLUMNS = {
    "kind": "string", "metric_a": "string", "metric_b": "string", "lag_days": "int", "coefficient": "double", "p_value": "double", "p_value_adj": "double",
    "ref_date": "date", "window_start": "date", "window_end": "date", "severity": "double", "details": "string", "note": "string",
}


def finding(df: DataFrame, kind: str, details: dict[str, Column] | None = None, **columns: Column) -> DataFrame:
    """Rows of one kind; columns not named are null, numbers have 4 decimals, details are JSON."""
    given = {"kind": F.lit(kind), **columns, "details": F.to_json(F.struct(*[c.alias(k) for k, c in (details or {}).items()])) if details else F.lit(None)}
    out = [(F.round(given[c].cast(t), 4) if t == "double" else given[c].cast(t)).alias(c) if c in given else F.lit(None).cast(t).alias(c) for c, t in COLUMNS.items()]
    return df.select(*out)


def correlations(residual: DataFrame, raw: DataFrame, detrended: DataFrame, c: C.Correlation) -> DataFrame:
    """Rank correlations of residuals that hold after control over all candidates, strongest lag of each pair, borne out by the raw series."""
    names = residual.select("series").distinct()
    redundant = K.is_volume(F.col("a")) & K.is_volume(F.col("b"))
    found = K.spearman(residual, K.pairs_at_lags(names, c.max_lag, redundant), c.min_overlap, c.min_active)
    found = K.adjusted(found.withColumn("p_value", K.p_value("coef", "n"))).filter((F.col("p_adj") <= c.keep_alpha) & (F.abs("coef") >= c.min_abs))
    best = K.best_lag(found)
    again = lambda s, name: K.spearman(s, best.select("a", "b", "lag"), 2).select("a", "b", "lag", F.col("coef").alias(name))
    best = best.join(again(raw, "raw_coef"), ["a", "b", "lag"], "left").join(again(detrended, "detr_coef"), ["a", "b", "lag"], "left")
    best = best.filter((F.signum("raw_coef") == F.signum("coef")) & (F.abs("raw_coef") >= c.raw_min_abs))
    tier = K.tier(K.domain(F.col("a")), K.domain(F.col("b")))
    r = lambda x: F.round(x, 4)
    return finding(best, "correlation", {"n": F.col("n"), "priority_tier": tier, "raw_coef": r("raw_coef"), "detr_coef": r("detr_coef")}, metric_a=F.col("a"), metric_b=F.col("b"), lag_days=F.col("lag"), coefficient=F.col("coef"), p_value=F.col("p_value"), p_value_adj=F.col("p_adj"), window_start=F.col("window_start"), window_end=F.col("window_end"), severity=F.abs("coef"))


def strongest_of_family(found: DataFrame) -> DataFrame:
    """One anomaly a day of the workout family, the strongest; all others as they are."""
    family = K.is_workout_family(F.col("series"))
    w = Window.partitionBy("day").orderBy(F.desc(F.abs("z")), "series")
    best = found.filter(family).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return found.filter(~family).unionByName(best)


def anomalies(series: DataFrame, a: C.Anomaly) -> DataFrame:
    found = strongest_of_family(robust.anomalies(series, a.window, a.threshold, a.recent_days, a.min_global_z))
    r = lambda x: F.round(x, 4)
    return finding(found, "anomaly", {"value": r("value"), "z": r("z"), "global_z": r("global_z")}, metric_a=F.col("series"), ref_date=F.col("day"), severity=F.abs("z"))


def trends(parts: DataFrame, s: C.Shape) -> DataFrame:
    ok = parts.filter("status = 'ok'")
    g = ok.groupBy("series").agg(D.strength("trend").alias("strength"), F.min("day").alias("a"), F.max("day").alias("b"))
    g = g.join(D.slope(ok, "trend"), "series").join(D.monotonicity(ok, "trend"), "series").filter((F.col("strength") >= s.trend_strength) & (F.col("monotonicity") >= s.min_monotonicity))
    return finding(g, "trend", {"slope_per_day": F.round("slope_per_day", 6), "strength": F.round("strength", 4), "monotonicity": F.round("monotonicity", 4)}, metric_a=F.col("series"), window_start=F.col("a"), window_end=F.col("b"), severity=F.col("strength"))


def seasons(parts: DataFrame, s: C.Shape) -> DataFrame:
    yearly = parts.filter("seasonal_365 is not null")
    profile = yearly.select("series", "day", (F.col("seasonal_365") + F.col("resid")).alias("value"))
    span = yearly.groupBy("series").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    g = D.annual(parts).join(D.reproducibility(profile), "series").join(span, "series").filter((F.col("strength") >= s.season_strength) & (F.col("reproducibility") >= s.reproducibility))
    r = lambda x: F.round(x, 4)
    details = {"strength": r("strength"), "reproducibility": r("reproducibility"), "amplitude": r("amplitude"), "peak_month": F.col("peak_month"), "trough_month": F.col("trough_month"), "phase_confident": F.col("phase_confident")}
    return finding(g, "seasonality", details, metric_a=F.col("series"), window_start=F.col("a"), window_end=F.col("b"), severity=F.col("strength"), note=F.when(~F.col("phase_confident"), "annual phase uncertain (peak and trough too close)"))


def recovery(series: DataFrame, r: C.Recovery, window: int = 28) -> DataFrame:
    """Days of high resting rate and low variability, within ``recent_days`` of the last day on which both have a score."""
    both = robust.scored_pairs(series, "resting_heart_rate", "heart_rate_variability", window)
    last = both.agg(F.max("day").alias("_last"))
    found = robust.alarming(both, r.z)
    sleep = robust.robust_z(series.filter("series = 'sleep_total_h'"), window).select("day", F.col("z").alias("_s"))
    found = found.crossJoin(F.broadcast(last)).filter(F.col("day") >= F.date_sub("_last", r.recent_days)).join(sleep, "day", "left")
    short = F.coalesce(F.col("_s") <= r.sleep_z, F.lit(False))
    return finding(found, "recovery_alert", {"resting_heart_rate_z": F.round("rest_z", 4), "heart_rate_variability_z": F.round("variability_z", 4), "short_sleep": short}, metric_a=F.lit("recovery"), ref_date=F.col("day"), severity=F.col("severity"), note=F.concat(F.lit("low HRV and high resting HR"), F.when(short, " with short sleep").otherwise("")))


def stress_alerts(days: DataFrame, s: C.Stress) -> DataFrame:
    """Days whose score reaches the alert level; the day's variability score only where there is one."""
    d = days.filter(F.col("score") >= s.alert)
    hrv = F.round("hrv_z", 4) if "hrv_z" in days.columns else F.lit(None).cast("double")
    details = {"score": F.round("score", 1), **{c: F.col(c).cast("int") for c in ("high_min", "medium_min", "rest_min")}, "hrv_z": hrv}
    return finding(d, "stress", details, metric_a=F.lit("stress"), ref_date=F.col("day"), severity=F.col("score"), note=F.lit("elevated daily stress"))


def energy_alerts(days: DataFrame, e: C.Energy) -> DataFrame:
    """Days whose lowest level is at or below the alert level; severity is how far it is from full."""
    d = days.filter(F.col("low_level") <= e.alert)
    details = {**{c: F.col(c).cast("int") for c in ("low_level", "high_level", "wake_level")}, **{c: F.round(F.col(c).cast("double"), 1) for c in ("charged", "drained")}}
    return finding(d, "body_battery", details, metric_a=F.lit("body_battery"), ref_date=F.col("day"), severity=100 - F.col("low_level"), note=F.lit("low energy reserve"))


def consistency(regular: DataFrame, c: C.Consistency) -> DataFrame:
    limit = F.when(F.col("series") == "bedtime", F.lit(c.bedtime_std)).otherwise(F.lit(c.duration_std))
    note = F.concat(F.when(F.col("std_hours") > limit, "irregular").otherwise("stable"), F.when(F.col("series") == "bedtime", " bedtime").otherwise(" sleep duration"))
    return finding(regular, "consistency", {"std_hours": F.round("std_hours", 4), "threshold": limit}, metric_a=F.col("series"), window_start=F.col("window_start"), window_end=F.col("window_end"), severity=F.col("std_hours"), note=note)


def load_targets(loads: DataFrame) -> DataFrame:
    """Of each sport (and the whole) the impulse series, else the energy one; never zone load."""
    base = F.regexp_extract("series", "^workout_(trimp|load)(_.*)?$", 1)
    sport = F.regexp_extract("series", "^workout_(trimp|load)(_.*)?$", 2)
    df = loads.withColumns({"_base": base, "_sport": sport}).filter("_base <> ''")
    has = df.filter("_base = 'trimp'").select(F.col("_sport").alias("_s")).distinct()
    return df.filter("_base = 'trimp'").unionByName(df.filter("_base = 'load'").join(F.broadcast(has), F.col("_sport") == F.col("_s"), "left_anti")).drop("_base", "_sport")


def training_load(loads: DataFrame, c: C.Load) -> DataFrame:
    w = Window.partitionBy("series").orderBy(F.desc("day"))
    now = training.acwr_history(loads).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").join(training.active_days(loads), "series")
    out = now.filter((F.col("active_days") >= c.min_active_days) & ((F.col("ratio") > c.acwr_high) | (F.col("ratio") < c.acwr_low)))
    return finding(out, "training_load", {**{k: F.round(k, 4) for k in ("acute", "chronic", "ratio")}, "acute_days": F.lit(C.ACUTE_DAYS), "chronic_days": F.lit(C.CHRONIC_DAYS)}, metric_a=F.col("series"), ref_date=F.col("day"), severity=F.col("ratio"), note=F.when(F.col("ratio") > c.acwr_high, "training load spike (acute load high vs. chronic)").otherwise("detraining (acute load low vs. chronic)"))


# The note of each zone.
ZONE_NOTES = {
    "detraining": "form strongly positive (load well below fitness - base shrinking)",
    "fresh": "fresh / tapered (form positive)",
    "neutral": "neutral (load matches fitness)",
    "productive": "productive training (moderate negative form)",
    "overreaching_risk": "overreaching risk (deeply negative form)",
}


def training_status(loads: DataFrame, c: C.Load = C.Load()) -> DataFrame:
    """One finding at most, of all sports together: of the impulse series where there is one, else of the energy one."""
    whole = loads.filter(F.col("series").isin("workout_trimp", "workout_load"))
    first = whole.agg(F.max("series").alias("_first"))  # by name the impulse series comes last
    whole = whole.join(F.broadcast(first), F.col("series") == F.col("_first")).drop("_first")
    s = training.training_status(training.smoothed(whole), c)
    details = {**{k: F.round(k, 4) for k in ("ctl", "atl", "tsb", "tsb_pct")}, "zone": F.col("zone"), "ctl_days": F.lit(C.CTL_TAU), "atl_days": F.lit(C.ATL_TAU), "ctl_ago": F.round("ctl_ago", 4), "ctl_trend": F.col("ctl_trend"), "ctl_trend_days": F.when(F.col("ctl_trend").isNotNull(), C.CTL_LOOKBACK)}
    return finding(s, "training_status", details, metric_a=F.col("series"), ref_date=F.col("day"), severity=F.abs("tsb_pct"), note=F.create_map(*[F.lit(x) for pair in ZONE_NOTES.items() for x in pair])[F.col("zone")])


def collect_kinds(builders: dict[str, Callable[[], DataFrame]], written: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame | None, dict[str, str]]:
    """All kinds that worked, each written as a table of its own first, and what went wrong with the others: one kind's fault stops no other."""
    out, failed = None, {}
    for kind, build in builders.items():
        try:
            rows = written(build(), kind)
        except Exception as e:  # contained and reported to the caller
            failed[kind] = f"{type(e).__name__}: {e}"[:500]
            continue
        out = rows if out is None else out.unionByName(rows)
    return out, failed


def store(findings: DataFrame, snapshot: str, history: str, computed_at) -> None:
    """Replaces the snapshot and adds the same rows to the history, all with one time."""
    stamped = findings.withColumn("computed_at", F.lit(computed_at).cast("timestamp"))
    stamped.write.mode("overwrite").parquet(snapshot)
    findings.sparkSession.read.parquet(snapshot).write.mode("append").parquet(history)


def feed(findings: DataFrame) -> DataFrame:
    """Each finding's day and a short text of it."""
    number = lambda key, n: F.round(F.get_json_object("details", f"$.{key}").cast("decimal(20,8)"), n).cast(f"decimal(20,{n})").cast("string")
    plain = lambda c, n: F.round(F.col(c).cast("decimal(20,8)"), n).cast(f"decimal(20,{n})").cast("string")
    k = F.col("kind")
    detail = (
        F.when(k == "anomaly", F.concat(number("z", 1), F.lit("σ (val: "), number("value", 2), F.lit(")")))
        .when(k == "training_load", F.concat(F.lit("ACWR "), number("ratio", 2))).when(k == "consistency", F.concat(number("std_hours", 2), F.lit("h std")))
        .when(k == "recovery_alert", F.concat(F.lit("RHR z="), number("resting_heart_rate_z", 1), F.lit(" HRV z="), number("heart_rate_variability_z", 1)))
        .when(k == "correlation", F.concat(F.lit("r="), plain("coefficient", 2), F.lit(" lag="), F.coalesce(F.col("lag_days").cast("string"), F.lit("0")), F.lit("d")))
        .otherwise(plain("severity", 2))
    )
    return findings.withColumns({"day": F.coalesce("ref_date", "window_end"), "detail": detail})


def alert_markers(history: DataFrame) -> DataFrame:
    """One row for each kind and alert day, the newest run's."""
    w = Window.partitionBy("kind", "ref_date").orderBy(F.desc("computed_at"), "metric_a")
    return history.filter("ref_date is not null").withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")

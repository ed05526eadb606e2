"""The registered queries of the telemetry operators over the adapters; each has its SQL under the same key where SQL can express it."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitalgrid import config as C
from vitalgrid.functions.clock import dense
from vitalgrid.functions.tables import kept
from vitalgrid.functions.text import slug, with_canonical_type
from vitalgrid.operators import audit, correlation, daily, decompose, energy, findings, narrate, passes, robust, series, sleep, stress, training
from vitalgrid.plans.fixtures import HR_MAX, ZONE, Tables
from vitalgrid.schema import NAMES, groups
from vitalgrid.sources import merge, payload

#: Names that metric_domains deals to the parts.
DOMAIN_NAMES = [
    "sleep_total_h", "respiratory_rate", "heart_rate_variability", "cardio_recovery", "heart_rate", "resting_heart_rate", "walking_heart_rate_average", "vo2_max", "apple_sleeping_wrist_temperature", "weight_body_mass",
    "blood_oxygen_saturation", "body_temperature", "breathing_disturbances", "physical_effort", "time_in_daylight", "step_count", "active_energy", "workout_trimp", "workout_intensity", "workout_duration", "workouts", "environmental_audio_exposure",
]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Tables], DataFrame]):
    """Registers ``f`` under its name as a function of (spark, folder)."""
    QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
    return f


def _round(df: DataFrame, n: int = 4) -> DataFrame:
    return df.select(*[F.round(f.name, n).alias(f.name) if f.dataType.typeName() == "double" else f.name for f in df.schema])


def _series(t: Tables) -> DataFrame:
    return daily.daily_series(t.samples(), t.registry(), ZONE)


@query
def daily_metrics(t):
    return _round(daily.daily_metrics(t.samples(), ZONE))


@query
def daily_by_registry(t):
    return _round(_series(t))


@query
def dense_grid(t):
    return _round(daily.gaps_as_null(_series(t)))


@query
def zero_fill(t):
    return _round(daily.gaps_as_zero(_series(t)))


@query
def sleep_nightly(t):
    return sleep.nightly(t.sleep()).select("id", "sleep_date", "source", F.round("total_sleep_h", 4).alias("total_sleep_h"))


@query
def sleep_metrics(t):
    return sleep.with_efficiency(sleep.nightly(t.sleep())).select("id", "sleep_date", F.round("in_bed_h_calc", 4).alias("in_bed_h_calc"), F.round("efficiency_pct", 1).alias("efficiency_pct"))


@query
def sleep_frame(t):
    return _round(sleep.frame(sleep.nightly(t.sleep()), ZONE), 6)


@query
def consistency(t):
    f = sleep.frame(sleep.nightly(t.sleep()), ZONE)
    long = f.select(F.lit("sleep_total_h").alias("series"), "day", F.col("sleep_total_h").alias("value")).unionByName(f.select(F.lit("bedtime").alias("series"), "day", sleep.bedtime_offset(F.col("bedtime")).alias("value")))
    return _round(sleep.regularity(long, 14))


@query
def explorer_categories(t):
    return daily.categories(t.samples(), t.registry())


@query
def explorer_metrics(t):
    return t.samples().select("metric").distinct().join(F.broadcast(t.registry().filter("category = 'events'").select("metric", "unit", "agg")), "metric")


@query
def explorer_latest(t):
    return daily.latest(_series(t))


@query
def explorer_7d_avg(t):
    return daily.trailing(_series(t), 7, "avg")


@query
def explorer_30d_min(t):
    return daily.trailing(_series(t), 30, "min")


@query
def explorer_30d_max(t):
    return daily.trailing(_series(t), 30, "max")


@query
def moving_avg_7(t):
    return _round(daily.moving_average(_series(t)))


@query
def daily_band(t):
    return _round(daily.daily_metrics(t.samples(), ZONE).select("day", "metric", "min", "avg", "max"))


@query
def sample_counts(t):
    return daily.daily_metrics(t.samples().withColumn("n", F.lit(1)), ZONE).select("day", "metric", F.col("n").cast("long").alias("n"))


@query
def raw_top500(t):
    return daily.newest(t.samples()).select("time", "metric", "source", F.round(F.coalesce("vavg", "qty"), 4).alias("value"))


@query
def json_points(t):
    rows = payload.samples(payload.metric_points(t.payloads()))
    return rows.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.count("qty").alias("n_qty"), F.count("vavg").alias("n_avg"), F.count("vmin").alias("n_min"), F.round(F.sum(F.coalesce("vavg", "qty")), 2).alias("total"), F.min("time").alias("first_time"))


def _unit_rows(t):
    e = t.raw("events")
    metric = F.element_at(F.array(*map(F.lit, ("active_energy", "step_count", "heart_rate", "mystery"))), (F.col("event_id") % 4 + 1).cast("int"))
    unit = F.element_at(F.array(F.lit("kJ"), F.lit("kcal"), F.lit("count"), F.lit("count/min"), F.lit(None).cast("string")), (F.col("event_id") % 5 + 1).cast("int"))
    nothing = F.lit(None).cast("double")
    return e.select("event_id", metric.alias("metric"), unit.alias("unit"), F.col("value").alias("qty"), nothing.alias("vmin"), nothing.alias("vavg"), nothing.alias("vmax"))


@query
def unit_normalise(t):
    return payload.normalise_units(_unit_rows(t)).select("event_id", "metric", "unit", "flagged", F.round("qty", 4).alias("qty"))


@query
def bounds_guard(t):
    return payload.plausible(payload.normalise_units(_unit_rows(t))).groupBy("metric", "flagged", "implausible").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("qty"), 2).alias("total"))


def _names(t):
    names = [n for x in NAMES.values() for n in x] + ["  Outdoor   Run ", "Unknown Sport", "LAUFEN"]
    a = F.array(*map(F.lit, names))
    return t.raw("orders").select("o_orderkey", F.element_at(a, (F.col("o_orderkey") % len(names) + 1).cast("int")).alias("name"))


@query
def name_canonical(t):
    return with_canonical_type(_names(t)).select("o_orderkey", "name", "canonical_type")


@query
def slugify(t):
    return t.raw("part").select("p_partkey", slug(F.concat(F.lit(" "), "p_name", F.lit("--"), "p_brand", F.lit("# "))).alias("slug"))


def _line_seq():
    return F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


@query
def last_wins(t):
    rows = merge.last_wins(t.raw("lineitem").withColumn("_s", _line_seq()), ["l_orderkey", "l_linenumber"], "_s")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query
def best_wins_sleep(t):
    return merge.best_wins(t.sleep(), ["sleep_end", "source"], "total_sleep_h", "id").select("id", "sleep_end", "source", F.round("total_sleep_h", 4).alias("total_sleep_h"))


@query
def collapse_sleep(t):
    return merge.collapse_sleep(t.sleep()).select("id", "sleep_end", "source")


@query
def hash_dedup(t):
    docs = t.raw("documents").select("doc_id", "text")
    """The archive's hashes after two batches, the second of which holds repeats of the first."""
    seen = merge.unseen(docs.filter("doc_id % 2 = 0").select("text"), t.spark.createDataFrame([], "content_hash string"), "text").select("content_hash")
    return seen.unionByName(merge.unseen(docs.filter("doc_id % 2 <> 0").select("text"), seen, "text").select("content_hash"))


@query
def anti_register(t):
    rows = t.samples().withColumn("pos", F.col("time"))
    return payload.unregistered(rows, t.registry().filter("agg = 'sum'"))


def _halves(t):
    s = t.samples().select(F.date_trunc("hour", "time").alias("time"), "metric", F.coalesce("vavg", "qty").alias("value"), F.unix_micros("time").alias("seq"))
    return s.filter("seq % 3 <> 0"), s.filter("seq % 3 = 0")


@query
def upsert_samples(t):
    stored, new = _halves(t)
    keys = ["metric", "time"]
    out = merge.upsert(merge.last_wins(stored, keys, "seq"), merge.last_wins(new, keys, "seq"), keys, "seq")
    return out.select("time", "metric", F.round("value", 4).alias("value"), "seq")


@query
def upsert_new_count(t):
    stored, new = _halves(t)
    return merge.new_keys(stored, new, ["metric", "time"]).groupBy("metric").agg(F.count(F.lit(1)).alias("n_new"))


@query
def trimp_session(t):
    return _round(training.session_impulse(t.workouts(), t.hr(), t.resting(), ZONE))


@query
def trimp_daily(t):
    return _round(training.daily_impulse(training.session_impulse(t.workouts(), t.hr(), t.resting(), ZONE)))


@query
def trimp_rest_baseline(t):
    days = t.workouts().select(F.to_date("start_time").alias("day"))
    return _round(training.rest_by_day(days, t.resting()))


@query
def rolling_rest(t):
    return _round(training.rolling_rest(t.resting()))


@query
def edwards(t):
    return _round(training.edwards(t.workouts(), t.hr(), HR_MAX))


def _workout_daily(t, by=None):
    zones = training.edwards(t.workouts(), t.hr(), HR_MAX)
    return training.workout_daily(t.workouts(), zones, training.rolling_rest(t.resting()), ZONE, 60.0, HR_MAX, by=by)


@query
def workout_daily(t):
    return _round(_workout_daily(t), 6)


@query
def workout_daily_by_type(t):
    return _round(_workout_daily(t, ["canonical_type"]), 6)


@query
def load_by_group(t):
    return _round(training.load_by_group(t.workouts(), groups(t.spark), ZONE))


@query
def load_focus(t):
    return _round(training.load_focus(t.workouts(), t.hr(), ZONE, HR_MAX))


def _loads(t):
    return dense(t.order_series(), ["series"], fill={"value": 0.0})


@query
def acwr_history(t):
    return _round(training.acwr_history(_loads(t)))


@query
def ewma_status(t):
    return _round(training.training_status(training.smoothed(_loads(t))).select("series", "day", "ctl", "atl", "tsb", "tsb_pct", "zone", "ctl_ago", "ctl_trend"), 3)


@query
def active_days(t):
    return training.active_days(_loads(t))


@query
def robust_z(t):
    return _round(robust.robust_z(t.order_series()))


@query
def anomalies(t):
    return _round(robust.anomalies(t.order_series(), threshold=2.5))


@query
def global_z(t):
    return _round(robust.global_z(t.order_series()))


@query
def recovery_pairs(t):
    return _round(robust.recovery_pairs(t.order_series(), "1-URGENT", "2-HIGH", z=0.8))


def _spearman(t):
    s = t.order_series()
    return correlation.spearman(s, correlation.pairs_at_lags(s.select("series").distinct(), 3), 42, 10)


@query
def spearman_lags(t):
    return _round(_spearman(t), 6)


@query
def corr_best_lag(t):
    return _round(correlation.best_lag(_spearman(t).withColumn("coef", F.round("coef", 6))), 6)


@query
def corr_p_values(t):
    return _round(_spearman(t).withColumn("p_value", correlation.p_value("coef", "n")).select("a", "b", "lag", "p_value"), 6)


@query
def findings_correlation(t):
    """Findings of all pairs of order series at their best lags, with adjusted p values, borne out by the same series."""
    s = t.order_series()
    return findings.correlations(s, s, s, C.Correlation(keep_alpha=1.0, min_abs=0.0, raw_min_abs=0.0)).drop("details", "note", "ref_date")


@query
def bh_fdr(t):
    o = t.raw("orders").select(F.col("o_orderkey").alias("a"), F.lit("x").alias("b"), F.lit(0).alias("lag"), ((F.col("o_orderkey") * 7919 % 100003 + 1) / 100004.0).alias("p_value")).dropDuplicates(["a"])
    return _round(correlation.adjusted(o).select("a", "p_value", "p_adj"), 6)


@query
def trend_slope(t):
    return _round(decompose.slope(t.order_series()))


@query
def monotonicity(t):
    return _round(decompose.monotonicity(t.order_series()), 6)


@query
def month_profile_repro(t):
    return _round(decompose.reproducibility(t.order_series()))


@query
def interpolate_gaps(t):
    return _round(decompose.interpolated(t.order_series()))


@query
def stl_components(t):
    return _round(decompose.decompose(t.order_series()))


@query
def seasonality(t):
    return _round(decompose.annual(decompose.decompose(t.order_series())))


# What stl_planted plants (slope a day, one week, size of the year, half width of the noise) and how near it must come out.
PLANTED_SLOPE, PLANTED_WEEK, PLANTED_YEAR, PLANTED_NOISE = 0.01, (3.0, 1.0, 0.0, -1.0, -2.0, -1.0, 0.0), 10.0, 2.0
WEEK_RMS, YEAR_RMS, SLOPE_SHARE, NOISE_SHARES, STRENGTH_LEAST = 0.6, 1.0, 0.05, (0.5, 1.05), 0.8


@query
def stl_planted(t):
    """Known trend, week, year and noise on the days of each order series, and whether the decomposition gives each back within bounds:
    root mean square errors of the seasonal parts, share of the slope, share of the noise's variance, strengths of trend and year.
    """
    day = F.unix_date("day")
    week = F.element_at(F.array(*map(F.lit, PLANTED_WEEK)), (day % 7 + 1).cast("int"))
    year = PLANTED_YEAR * F.cos(2 * math.pi * day / C.YEAR)
    noise = (F.pmod(F.xxhash64("series", "day"), F.lit(10_001)) / 5_000 - 1) * PLANTED_NOISE
    planted = t.order_series().select("series", "day", (100 + PLANTED_SLOPE * day + week + year + noise).alias("value"))
    parts = kept(decompose.decompose(planted), "parts")
    rms = lambda part, truth: F.sqrt(F.avg(F.pow(F.col(part) - truth, 2)))
    share = F.var_pop("resid") / (PLANTED_NOISE**2 / 3)
    g = parts.groupBy("series").agg(
        F.count(F.lit(1)).alias("days"), (rms("seasonal_7", week) <= WEEK_RMS).alias("week_ok"), (rms("seasonal_365", year) <= YEAR_RMS).alias("year_ok"), share.between(*NOISE_SHARES).alias("noise_ok"),
        ((decompose.strength("trend") >= STRENGTH_LEAST) & (decompose.strength("seasonal_365") >= STRENGTH_LEAST)).alias("strength_ok"),
    )
    slope = decompose.slope(parts, "trend").select("series", (F.abs(F.col("slope_per_day") / PLANTED_SLOPE - 1) <= SLOPE_SHARE).alias("slope_ok"))
    return g.join(slope, "series")


STRESS = C.Stress()


def _timeline(t):
    rest = t.samples().groupBy(F.to_date("time").alias("day")).agg((55 + F.count(F.lit(1)) % 11).cast("double").alias("rest"))
    hrv = t.samples().groupBy(F.to_date("time").alias("day")).agg(((F.count(F.lit(1)) % 5) / 2.0 - 1.0).alias("hrv_z"))
    return kept(stress.timeline(t.hr_events(), rest, hrv, t.intervals(), t.steps_events(), ZONE, STRESS, HR_MAX, 60.0), "timeline")  # the reserve is made of a stored timeline


@query
def stress_intraday(t):
    return _round(_timeline(t))


@query
def stress_daily(t):
    return _round(stress.daily(_timeline(t)), 3)


@query
def interval_semi(t):
    return stress.inside(t.hr_events(), t.intervals()).groupBy(F.to_date("ts").alias("day"), "inside").agg(F.count(F.lit(1)).alias("n"))


@query
def interval_value(t):
    return stress.first_match(t.hr_events(), t.sleep_intervals(), "efficiency", "eff").filter("eff is not null").select("ts", "eff")


@query
def steps_gate(t):
    return stress.cadence_is_fine(t.steps_events())


@query
def merged_intervals(t):
    return stress.merged(t.intervals())


@query
def auto_neutral(t):
    return energy.auto_neutral(_timeline(t), t.sleep_intervals())


@query
def battery_rates(t):
    return _round(energy.rates(_timeline(t), t.sleep_intervals(), F.lit(25.0), C.Energy()).select("ts", "rate", "dwell", "delta"))


def _levels(t):
    return energy.integrate(energy.rates(_timeline(t), t.sleep_intervals(), F.lit(25.0), C.Energy()))


@query
def battery_levels(t):
    return _round(_levels(t), 3)


@query
def battery_daily(t):
    return _round(energy.daily(_levels(t), energy.wake_ends(t.sleep_intervals(), ZONE), ZONE), 2)


@query
def coverage_audit(t):
    return audit.coverage(daily.daily_metrics(t.samples(), ZONE), t.registry())


@query
def unit_audit(t):
    rows = t.samples().withColumn("unit", F.when(F.col("source").cast("long") % 10 == 3, F.lit("other")).otherwise(F.col("unit")))
    return audit.unit_anomalies(rows, t.registry())


@query
def unmapped(t):
    return audit.unmapped(_names(t)).select("name", F.col("count").alias("n"))


@query
def payload_census(t):
    g = t.raw("lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(F.lit("{}")), ",").alias("d"))
    return audit.census(g.select(F.concat(F.lit('{"data":{"workouts":[{"heartRateData":['), "d", F.lit("]}]}}")).alias("body")))


def _findings(t):
    z = robust.anomalies(t.order_series(), threshold=2.5)
    a = findings.finding(z, "anomaly", {"value": F.round("value", 4), "z": F.round("z", 4)}, metric_a=F.col("series"), ref_date=F.col("day"), severity=F.abs("z"))
    b = findings.finding(training.acwr_history(_loads(t)).filter("ratio > 1.5"), "training_load", {"ratio": F.round("ratio", 4)}, metric_a=F.col("series"), ref_date=F.col("day"), severity=F.col("ratio"))
    c = findings.finding(_spearman(t), "correlation", metric_a=F.col("a"), metric_b=F.col("b"), lag_days=F.col("lag"), coefficient=F.col("coef"), window_end=F.col("window_end"), severity=F.abs("coef"))
    return a.unionByName(b).unionByName(c)


@query
def findings_feed(t):
    return findings.feed(_findings(t)).select("kind", "metric_a", "metric_b", "lag_days", "day", "detail")


@query
def findings_labelled(t):
    """Dated findings of 1998 on and all standing ones, with names of the series where there are any."""
    o = F.col("o_orderpriority")
    names = t.raw("orders").filter(o != "5-LOW").select(o.alias("metric"), F.initcap(F.substr(o, F.lit(3))).alias("display_name")).distinct()
    shown = narrate.labelled(narrate.current(_findings(t), "1998-01-01"), names)
    return shown.select("kind", "metric_a", "metric_a_label", "metric_b", "metric_b_label", "lag_days", F.coalesce("ref_date", "window_end").alias("day"))


@query
def findings_by_kind(t):
    return audit.by_kind(_findings(t))


@query
def priority_rank(t):
    s = _spearman(t)
    name = {"1-URGENT": "sleep_total_h", "2-HIGH": "heart_rate_variability", "3-MEDIUM": "step_count", "4-NOT SPECIFIED": "time_in_daylight", "5-LOW": "heart_rate"}
    as_metric = lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in name.items() for x in kv]), F.col(c))
    d = s.withColumns({"da": correlation.domain(as_metric("a")), "db": correlation.domain(as_metric("b"))}).withColumn("tier", correlation.tier(F.col("da"), F.col("db")))
    return _round(d.select("a", "b", "lag", "da", "db", "tier", correlation.priority(F.col("tier"), F.col("coef"), F.col("lag")).alias("priority")), 5)


@query
def alert_markers(t):
    h = _findings(t).filter("kind <> 'correlation'").withColumn("computed_at", F.lit("2024-01-01").cast("timestamp"))
    return findings.alert_markers(h).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class _AnyShape(C.Shape):
    """Every shape: a mean rank correlation goes down to -1, which settings may not ask for."""

    reproducibility: float = C.within(-1.0, -1, 1)


def _sport_loads(t):
    """Impulse and energy series of each sport (daily order totals by priority, in whole and in thousands), and of all sports together."""
    s = t.order_series()
    sport = s.select(F.concat(F.lit("_"), slug(F.col("series"))).alias("sport"), "day", "value").unionByName(s.select(F.lit("").alias("sport"), "day", "value"))
    sport = sport.groupBy("sport", "day").agg(F.sum("value").alias("value"))
    named = lambda kind, value: sport.select(F.concat(F.lit(f"workout_{kind}"), "sport").alias("series"), "day", value.alias("value"))
    return dense(named("trimp", F.col("value")).unionByName(named("load", F.col("value") / 1000)), ["series"], fill={"value": 0.0})


@query
def findings_all(t):
    """Findings of six kinds, with what each measured in ``details``; no bound on shape or correlation hides one."""
    s = t.order_series()
    parts = kept(decompose.decompose(s), "parts")
    residual, flat = decompose.residuals(parts), decompose.detrended(parts)
    loads = _sport_loads(t)
    shape = _AnyShape(trend_strength=0.0, min_monotonicity=0.0, season_strength=0.0, reproducibility=-1.0)
    out = findings.anomalies(s, C.Anomaly())
    for more in (findings.correlations(residual, s, flat, C.Correlation(keep_alpha=1.0, min_abs=0.0, raw_min_abs=0.0)), findings.trends(parts, shape), findings.seasons(parts, shape), findings.training_load(findings.load_targets(loads), C.Load()), findings.training_status(loads)):
        out = out.unionByName(more)
    return out


@query
def projected_decay(t):
    """Chronic and acute load of the last day, carried thirty days on at no load."""
    last = Window.partitionBy("series").orderBy(F.desc("day"))
    now = training.smoothed(_loads(t)).withColumn("_rn", F.row_number().over(last)).filter("_rn = 1")
    ahead = now.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(30))))
    fall = lambda c, tau: F.col(c) * F.pow(F.lit(1 - 1 / tau), F.col("k"))
    return _round(ahead.select("series", "k", fall("ctl", C.CTL_TAU).alias("ctl"), fall("atl", C.ATL_TAU).alias("atl")), 3)


@query
def metric_domains(t):
    """The domain, and whether it counts as activity volume, of the series that parts are named after, and how many parts each names."""
    pick = F.element_at(F.array(*map(F.lit, DOMAIN_NAMES)), (F.col("p_partkey") % len(DOMAIN_NAMES) + 1).cast("int"))
    named = t.raw("part").groupBy(pick.alias("series")).agg(F.count(F.lit(1)).alias("n"))
    return named.select("series", correlation.domain(F.col("series")).alias("domain"), correlation.is_volume(F.col("series")).alias("volume"), "n")


def _pass(t, subjects=None, since_days=None):
    c = C.Config(zone=ZONE)
    buckets, days = passes.stress_pass(t.vital_samples(subjects), t.vital_workouts(subjects), c, since_days)
    return c, buckets, days


@query
def stress_pass(t):
    return _round(_pass(t)[2])


@query
def stress_pass_buckets(t):
    return _round(_pass(t)[1])


@query
def stress_pass_by_subject(t):
    return _round(_pass(t, subjects=3)[2])


@query
def energy_pass(t):
    c, buckets, _ = _pass(t)
    return passes.energy_pass(buckets, t.vital_sleep(), c)[1]


@query
def workout_series(t):
    """Series of all sessions and loads of each type, zero on rest days; intensity keeps its gaps."""
    return _round(series.workouts(_workout_daily(t), _workout_daily(t, ["canonical_type"])), 6)


@query
def workout_series_energy(t):
    """The same with energy loads alone and no zone load."""
    return _round(series.workouts(_workout_daily(t), _workout_daily(t, ["canonical_type"]), "energy", edwards=False), 6)

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vitalgrid import config as C
from vitalgrid.functions import impulse
from vitalgrid.functions.clock import local_day, parse_instant
from vitalgrid.functions.text import slug, with_canonical_type
from vitalgrid.operators import correlation, decompose, energy, findings, robust, sleep, stress, training
from vitalgrid.schema import NAMES, registry_rows
from vitalgrid.sources import merge, payload


def series(spark, values, name="s", start="2024-01-01"):
    days = pd.date_range(start, periods=len(values)).date
    return spark.createDataFrame([(name, d, float(v)) for d, v in zip(days, values) if v is not None], "series string, day date, value double")


def at(minutes, day="2024-01-01"):
    return dt.datetime.fromisoformat(day) + dt.timedelta(minutes=minutes)


def test_registry_and_names_are_whole():
    rows = registry_rows()
    assert len(rows) == 39 and sum(r[4] == "core" for r in rows) == 19
    assert sum(map(len, NAMES.values())) == len({n for x in NAMES.values() for n in x})


def test_config_refuses_unknown_and_contradictory():
    assert C.from_dict({"anomaly": {"window": 14}}).anomaly.window == 14
    for bad in ({"nope": 1}, {"stress": {"low": 80.0}}, {"stress": {"enabled": False}}, {"profile": {"hr_max": 50.0, "hr_rest": 60.0}}):
        with pytest.raises(ValueError):
            C.from_dict(bad)


def test_times_and_local_days(spark):
    rows = [("2026-07-07 23:30:00 +0000",), ("2026-07-07 23:30:00 +02:00",), ("garbage",), (None,)]
    got = spark.createDataFrame(rows, "s string").select(parse_instant(F.col("s")).alias("t")).select(local_day(F.col("t"), "Europe/Vienna").alias("d")).collect()
    assert [r.d for r in got] == [dt.date(2026, 7, 8), dt.date(2026, 7, 7), None, None]


def test_names_fold_and_slug(spark):
    df = spark.createDataFrame([("Outdoor  Run ",), ("Chess",), (None,)], "name string")
    assert [r.canonical_type for r in with_canonical_type(df, {"chess": "Board Games"}).orderBy("name").collect()] == [None, "board_games", "running"]
    assert spark.range(1).select(slug(F.lit("  A--b!! C "))).first()[0] == "a_b_c"


BODY = {"data": {
    "metrics": [
        {"name": "heart_rate", "units": "count/min", "data": [{"date": "2024-05-01 10:00:00 +0200", "Min": None, "Avg": 62, "Max": 70}, {"date": "bad", "Avg": 1}, {"date": "2024-05-01 10:01:00 +0200", "Avg": 999}]},
        {"name": "active_energy", "units": "kJ", "data": [{"date": "2024-05-01 10:00:00 +0200", "qty": "100"}]},
        {"name": "brand_new", "units": "x", "data": [{"date": "2024-05-01 10:00:00 +0200", "qty": 1}]},
        {"name": "sleep_analysis", "units": "hr", "data": [{"date": "2024-05-02 00:30:00 +0200", "sleepStart": "2024-05-01 23:00:00 +0200", "sleepEnd": "2024-05-02 07:00:00 +0200", "totalSleep": 7.5}]},
        {"name": "", "data": [{"date": "2024-05-01 10:00:00 +0200", "qty": 1}]},
    ],
    "workouts": [
        {"id": "0F8FAD5BD9CB469FA16570867728950E", "name": "Laufen", "start": "2024-05-01 10:00:00 +0200", "duration": 600, "activeEnergyBurned": {"qty": 100, "units": "kJ"}, "distance": 2.5,
         "heartRateData": [{"date": "2024-05-01 10:00:00 +0200", "qty": 120}, {"date": "2024-05-01 10:01:00 +0200", "Avg": 130, "qty": 1}, {"date": "x", "qty": 1}],
         "route": [{"timestamp": "2024-05-01 10:00:00 +0200", "lat": 1.0, "lon": 2.0}, {"timestamp": "2024-05-01 10:01:00 +0200", "latitude": 1.5, "longitude": 2.5, "speed": 3}, {"timestamp": "2024-05-01 10:01:00 +0200"}]},
        {"id": "nope", "name": "Yoga"},
    ],
}}


def test_payload_row_sets(spark):
    bodies = spark.createDataFrame([("a", json.dumps(BODY))], "path string, body string")
    points = payload.metric_points(bodies)
    rows = payload.plausible(payload.normalise_units(payload.samples(points)))
    got = {(r.metric, r.implausible): r for r in rows.collect()}
    assert got["heart_rate", False].vavg == 62 and got["heart_rate", False].vmin is None and got["heart_rate", False].qty is None
    assert ("heart_rate", True) in got and len(got) == 4
    assert got["active_energy", False].qty == pytest.approx(23.90057361) and got["active_energy", False].unit == "kcal"
    assert str(payload.sleep_rows(points).first().sleep_date) == "2024-05-02"
    sessions, dropped = payload.workouts(bodies)
    w = sessions.first()
    assert (w.hae_id, w.canonical_type, w.distance_km) == ("0f8fad5b-d9cb-469f-a165-70867728950e", "running", 2.5) and w.active_energy_kcal == pytest.approx(23.90057361)
    assert [r.bpm for r in payload.hr_samples(sessions).orderBy("ts").collect()] == [120, 130] and payload.route_points(sessions).count() == 2
    assert dropped.first().name == "Yoga"
    assert [r.metric for r in payload.unregistered(rows, spark.createDataFrame([("heart_rate",), ("active_energy",)], "metric string")).collect()] == ["brand_new"]


def test_nan_passes_the_bounds(spark):
    df = spark.createDataFrame([("heart_rate", float("nan"), False), ("heart_rate", 10.0, False), ("heart_rate", 10.0, True), ("other", 1e9, False)], "metric string, vavg double, flagged boolean").withColumn("qty", F.lit(None).cast("double"))
    assert sorted(r.implausible for r in payload.plausible(df).collect()) == [False, False, False, True]


def test_upserts(spark):
    old = spark.createDataFrame([("k", 1.0, "run", 1), (None, 2.0, None, 1)], "key string, value double, kind string, seq int")
    new = spark.createDataFrame([("k", 5.0, None, 2), (None, 3.0, "x", 2)], "key string, value double, kind string, seq int")
    got = {r.key: r for r in merge.upsert(old, new, ["key"], "seq", ["kind"]).collect()}
    assert (got["k"].value, got["k"].kind, got[None].value) == (5.0, "run", 3.0)
    again = merge.upsert(merge.upsert(old, new, ["key"], "seq", ["kind"]), new, ["key"], "seq", ["kind"])
    assert sorted(map(str, again.collect())) == sorted(map(str, got.values()))
    for a, b in ((1.0, 2.0), (2.0, 1.0)):
        one = spark.createDataFrame([("n", a, 1)], "key string, value double, seq int")
        two = spark.createDataFrame([("n", b, 1)], "key string, value double, seq int")
        assert merge.upsert_best(one, two, ["key"], "value", "seq").first().value == 2.0
    assert merge.new_keys(old, new, ["key"]).count() == 0


def test_window_replacement_drops_vanished_days(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(dt.date(2024, 1, d), d) for d in (1, 2, 3)], "day date, v int")
    rows.write.partitionBy("day").parquet(path)
    merge.replace_window(path, rows.filter("v = 3").withColumn("v", F.lit(9)), "day", "2024-01-02", "2024-01-03")
    assert sorted((str(r.day), r.v) for r in spark.read.parquet(path).collect()) == [("2024-01-01", 1), ("2024-01-03", 9)]


def test_session_impulse_rescales_and_falls_back(spark):
    w = spark.createDataFrame([("a", at(0), 240.0, 140.0, 180.0), ("b", at(0), 600.0, 120.0, None), ("c", at(0), 600.0, None, None), ("d", None, 60.0, 100.0, None)], "hae_id string, start_time timestamp, duration_s double, avg_hr double, max_hr double")
    hr = spark.createDataFrame([("a", at(0), 120.0), ("a", at(1), 180.0), ("a", at(2), 150.0)], "workout_hae_id string, ts timestamp, bpm double")
    rest = spark.createDataFrame([(dt.date(2023, 12, d), v) for d, v in ((29, 50.0), (30, 52.0), (31, 54.0), (1, 90.0))], "day date, value double")
    got = {r.hae_id: r.trimp for r in training.session_impulse(w, hr, rest, "UTC", 190).collect()}
    f = lambda bpm, minutes: minutes * (x := (bpm - 52) / 138) * 0.64 * np.exp(1.92 * x)
    assert got["a"] == pytest.approx(2 * (f(120, 1) + f(180, 1))) and got["b"] == pytest.approx(f(120, 10)) and got["c"] == 0 and "d" not in got


def test_edwards_and_zones(spark):
    w = spark.createDataFrame([("a", 240.0), ("b", 60.0)], "hae_id string, duration_s double")
    hr = spark.createDataFrame([("a", at(0), 95.0), ("a", at(1), 171.0), ("a", at(2), 80.0), ("b", at(0), 180.0)], "workout_hae_id string, ts timestamp, bpm double")
    assert {r.hae_id: r.edwards for r in training.edwards(w, hr, 190.0).collect()} == {"a": pytest.approx((1 + 5) * 2), "b": 0.0}
    assert spark.range(1).select(impulse.banister(F.lit(600.0), F.lit(100.0), F.lit(120.0), F.lit(110.0))).first()[0] == 0


def test_smoothing_follows_the_recursion(spark):
    x = np.random.default_rng(1).uniform(0, 50, 100)
    y = 0.0
    for v in x:
        y += (v - y) / 42
    path = training.smoothed(series(spark, x))
    assert path.orderBy(F.desc("day")).first().ctl == pytest.approx(y)
    assert training.training_status(path).count() == 1 and training.training_status(training.smoothed(series(spark, x[:41]))).count() == 0
    taper = training.training_status(training.smoothed(series(spark, [20.0] * 56 + [0.0] * 14))).first()
    block = training.training_status(training.smoothed(series(spark, [20.0] * 56 + [30.0] * 14))).first()
    assert taper.tsb > 0 > block.tsb and taper.zone == "detraining"


def test_robust_z_equals_pandas(spark):
    v = np.random.default_rng(2).normal(50, 2, 60)
    v[55] = 90
    got = robust.robust_z(series(spark, v)).orderBy("day").toPandas()
    s = pd.Series(v)
    m = s.shift(1).rolling(28).median()
    d = s.shift(1).rolling(28).apply(lambda x: np.median(np.abs(x - np.median(x))), raw=True)
    assert np.allclose(got["z"].astype(float), 0.6745 * (s - m) / d, equal_nan=True)
    assert robust.anomalies(series(spark, v)).count() == 1 and robust.robust_z(series(spark, [5.0] * 40)).filter("z is not null").count() == 0


def test_known_lag_is_found(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=150)
    b = np.concatenate([rng.normal(size=2), a[:-2]]) + rng.normal(0, 0.1, 150)
    both = series(spark, a, "a").unionByName(series(spark, b, "b"))
    found = correlation.spearman(both, correlation.pairs_at_lags(both.select("series").distinct(), 3))
    best = correlation.best_lag(found).first()
    assert (best.a, best.b, best.lag) == ("a", "b", 2) and best.coef > 0.9
    assert correlation.spearman(series(spark, a[:30], "a").unionByName(series(spark, b[:30], "b")), correlation.pairs_at_lags(both.select("series").distinct(), 0)).count() == 0


def test_p_values_and_adjustment(spark):
    # Published table values of Student's t.
    assert np.allclose(correlation.tail(np.array([2.228, 2.042, 12.706, 0.0]), np.array([10, 30, 1, 5])), [0.05, 0.05, 0.05, 1.0], atol=2e-4)
    p = [0.01, 0.04, 0.03, 0.005]
    df = spark.createDataFrame([("a", str(i), 0, x) for i, x in enumerate(p)], "a string, b string, lag int, p_value double")
    assert [r.p_adj for r in correlation.adjusted(df).orderBy("b").collect()] == pytest.approx([0.02, 0.04, 0.04, 0.02])


def test_decomposition_finds_trend_and_seasons(spark):
    rng, t = np.random.default_rng(4), np.arange(800)
    y = 10 * np.sin(2 * np.pi * t / 365) + 2 * np.sin(2 * np.pi * t / 7) + rng.normal(0, 0.5, 800)
    s = series(spark, y, "year").unionByName(series(spark, 0.5 * t[:150] + 2 * np.sin(2 * np.pi * t[:150] / 7), "week")).unionByName(series(spark, [1.0] * 10, "short"))
    parts = decompose.decompose(s).cache()
    assert {r.series: r.status for r in parts.select("series", "status").distinct().collect()} == {"year": "ok", "week": "ok", "short": "too short"}
    season = decompose.annual(parts).first()
    assert season.strength > 0.8 and season.peak_month in (3, 4) and season.trough_month in (9, 10) and season.phase_confident
    trend = findings.trends(parts, C.Shape()).collect()
    assert [r.metric_a for r in trend] == ["week"] and json.loads(trend[0].details)["slope_per_day"] == pytest.approx(0.5, abs=0.02)


def test_intervals(spark):
    iv = spark.createDataFrame([(at(0), at(10)), (at(5), at(20)), (at(30), at(40)), (at(1430), at(1450))], "start timestamp, end timestamp")
    assert stress.merged(iv).count() == 3
    pts = spark.createDataFrame([(at(m),) for m in (0, 19, 20, 30, 1445)], "ts timestamp")
    assert [r.inside for r in stress.inside(pts, iv).orderBy("ts").collect()] == [True, True, False, True, True]


def test_dwell_caps_gaps(spark):
    b = spark.createDataFrame([(at(0), dt.date(2024, 1, 1), 10, "rest"), (at(60), dt.date(2024, 1, 1), 10, "rest")], "ts timestamp, day date, stress int, state string")
    day = stress.daily(b).first()
    assert (day.rest_min, day.unmeasurable_min) == (11.0, 50.0)


def test_energy_equals_the_plain_walk(spark):
    rng = np.random.default_rng(5)
    d = rng.normal(0, 4, 3000)
    steps = spark.createDataFrame([(at(int(i) * 3), float(x)) for i, x in enumerate(d)], "ts timestamp, delta double")
    x, want = 50.0, []
    for v in d:
        x = min(100.0, max(0.0, x + v))
        want.append(x)
    got = [r.level for r in energy.integrate(steps).orderBy("ts").collect()]
    assert got == pytest.approx(want, abs=1e-9) and min(got) >= 0 and max(got) <= 100


def test_energy_day_summary(spark):
    levels = spark.createDataFrame([(at(60 * i), float(v)) for i, v in enumerate((50, 60, 55, 80, 70))], "ts timestamp, level double")
    wakes = spark.createDataFrame([(dt.date(2024, 1, 1), at(90))], "day date, wake timestamp")
    r = energy.daily(levels, wakes, "UTC").first()
    assert (r.charged, r.drained, r.wake_level, r.high_level, r.low_level) == (35.0, 15.0, 60.0, 80.0, 50.0)


def test_sleep_efficiency_definitions(spark):
    schema = "id int, sleep_date date, sleep_start timestamp, sleep_end timestamp, in_bed_start timestamp, in_bed_end timestamp, total_sleep_h double, asleep_h double, awake_h double, in_bed_h double"
    rows = [(1, dt.date(2024, 1, 1), at(0), at(480), at(0), at(600), 8.0, 0.0, 0.0, 0.0), (2, dt.date(2024, 1, 1), at(0), at(60), None, None, 1.0, None, None, None), (3, dt.date(2024, 1, 2), at(0), at(60), None, None, 6.0, 6.0, 2.0, 0.0)]
    n = sleep.nightly(spark.createDataFrame(rows, schema))
    assert {r.id: r.efficiency_pct for r in sleep.with_efficiency(n).collect()} == {1: 80.0, 3: 75.0}
    got = sorted((r.start, r.end, r.efficiency) for r in sleep.intervals(spark.createDataFrame(rows, schema).withColumn("sleep_end", F.col("sleep_start") + F.expr("interval 8 hours"))).collect())
    assert got == [(at(0), at(480), 0.8), (at(0), at(480), 1.0), (at(0), at(480), 1.0)]  # by time in bed; unknown; no time in bed


def test_findings_store_and_feed(spark, tmp_path):
    f = findings.finding(spark.createDataFrame([("x", dt.date(2024, 1, 1), 4.26, 2.0)], "s string, d date, z double, v double"), "anomaly", {"z": F.col("z"), "value": F.col("v")}, metric_a=F.col("s"), ref_date=F.col("d"), severity=F.col("z"))
    snap, hist = str(tmp_path / "snap"), str(tmp_path / "hist")
    for _ in range(2):
        findings.store(f, snap, hist, "2024-01-02 00:00:00")
    assert spark.read.parquet(snap).count() == 1 and spark.read.parquet(hist).count() == 2
    assert findings.feed(f).first().detail == "4.3σ (val: 2.00)"
    failed = findings.collect_kinds({"good": lambda: f, "bad": lambda: f.select("missing")}, lambda df, _: df)
    assert failed[0].count() == 1 and list(failed[1]) == ["bad"]

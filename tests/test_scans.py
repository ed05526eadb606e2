"""Running values without one task for all of them, subjects kept apart, and the settings and notes that passes obey."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalgrid import config as C
from vitalgrid.operators import energy, findings, series, stress, training
from vitalgrid.plans.catalog import QUERIES
from vitalgrid.sources import payload

START = dt.datetime(2004, 2, 27)


def minutes(m):
    return START + dt.timedelta(minutes=float(m))


def brute_merged(rows):
    out = []
    for a, b in sorted((a, b) for a, b in rows if b > a):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return sorted(map(tuple, out))


@pytest.mark.parametrize("subjects", [None, 2])
def test_merged_over_days(spark, subjects):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, subjects or 1)), *sorted(rng.integers(0, 60 * 24 * 12, 2).tolist())) for _ in range(12)]
    rows += [(0, a, a + int(rng.integers(0, 90))) for a in rng.integers(0, 60 * 24 * 40, 250).tolist()]
    rows += [(0, 60 * 24 * 50, 60 * 24 * 56), (0, 60 * 24 * 56, 60 * 24 * 56 + 5), (0, 60 * 24 * 51, 60 * 24 * 51)]
    df = spark.createDataFrame([(s, minutes(a), minutes(b)) for s, a, b in rows], "subject int, start timestamp, end timestamp")
    if subjects is None:
        got = sorted((r.start, r.end) for r in stress.merged(df.drop("subject")).collect())
        assert got == [(minutes(a), minutes(b)) for a, b in brute_merged([(a, b) for _, a, b in rows])]
    else:
        got = sorted((r.subject, r.start, r.end) for r in stress.merged(df).collect())
        assert got == sorted((s, minutes(a), minutes(b)) for s in range(subjects) for a, b in brute_merged([(a, b) for k, a, b in rows if k == s]))


def test_dwell_and_cadence_over_days(spark):
    at = [0, 1, 1439, 1441, 1441 + 4 * 1440, 1450 + 4 * 1440]
    b = spark.createDataFrame([(minutes(m), "rest") for m in at], "ts timestamp, state string")
    got = [r.dwell for r in stress.dwell(b).orderBy("ts").collect()]
    assert got == [1.0, 10.0, 2.0, 10.0, 9.0, 1.0]
    assert stress.cadence_is_fine(b.drop("state")).first().median_gap == 540.0
    assert not stress.cadence_is_fine(b.drop("state").limit(1)).first().fine


def test_reserve_over_twenty_years_equals_the_plain_walk(spark):
    rng = np.random.default_rng(5)
    n = 7300 * 4
    at = np.cumsum(rng.integers(200, 520, n))
    d = rng.normal(0, 15, n)
    steps = spark.createDataFrame(list(zip((minutes(m) for m in at), map(float, d))), "ts timestamp, delta double")
    x, want = 50.0, []
    for v in d:
        x = min(100.0, max(0.0, x + v))
        want.append(x)
    out = energy.integrate(steps, slot=3)
    assert [r.level for r in out.orderBy("ts").collect()] == pytest.approx(want, abs=1e-9)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString() and "Pandas" not in out._jdf.queryExecution().executedPlan().toString()


def test_smoothing_by_blocks_equals_the_recursion(spark):
    rng = np.random.default_rng(6)
    days = [dt.date(2004, 1, 5) + dt.timedelta(days=k) for k in range(2500)]
    x = {s: rng.uniform(0, 80, len(days)) * (rng.random(len(days)) < 0.5) for s in ("a", "b")}
    loads = spark.createDataFrame([(s, d, float(v)) for s in x for d, v in zip(days, x[s])], "series string, day date, value double")
    path = training.smoothed(loads)
    got = {(r.series, r.day): (r.value, r.ctl, r.atl) for r in path.collect()}
    assert len(got) == 5000
    for s in x:
        ctl = atl = 0.0
        for d, v in zip(days, x[s]):
            ctl += (v - ctl) / C.CTL_TAU
            atl += (v - atl) / C.ATL_TAU
            assert got[s, d] == pytest.approx((v, ctl, atl), abs=1e-9)
    assert "Python" not in path._jdf.queryExecution().executedPlan().toString() and "Pandas" not in path._jdf.queryExecution().executedPlan().toString()
    assert training.smoothed(loads.limit(0)).count() == 0


def unkeyed_windows(plan):
    """Window nodes whose rows come from a single partition, but for those along the days of one series: a row a day is no whole table."""
    lines = plan.splitlines()
    for k, line in enumerate(lines):
        if ("- Window [" in line or line.lstrip().startswith("Window [")) and "windowspecdefinition(day#" not in line:
            below = next((x for x in lines[k + 1 :] if "Exchange" in x), "")
            if "SinglePartition" in below:
                yield line


@pytest.mark.parametrize("name", ["merged_intervals", "steps_gate", "interval_semi", "stress_intraday", "stress_daily", "auto_neutral", "battery_rates", "battery_levels", "battery_daily", "stress_pass", "energy_pass", "trimp_session", "trimp_rest_baseline", "ewma_status"])
def test_no_window_over_a_whole_table(spark, monkeypatch, name):
    from vitalgrid.functions import tables
    from vitalgrid.operators import energy as e, passes
    from vitalgrid.plans import catalog

    plans, real = [], tables.kept

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, label)

    for module in (e, passes, catalog):
        monkeypatch.setattr(module, "kept", seen)
    plans.append(QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString())
    assert any("Exchange" in p for p in plans) and [w for p in plans for w in unkeyed_windows(p)] == []


def test_sessions_of_two_subjects(spark):
    """Two people's sessions in one table give what each gives alone."""
    rng = np.random.default_rng(8)
    sessions = [(k % 2, f"s{k}", minutes(1440 * k), float(600 + 10 * k), float(110 + k), float(150 + 7 * k)) for k in range(10)]
    hr = [(k % 2, f"s{k}", minutes(1440 * k + m), float(rng.integers(90, 170))) for k in range(0, 10, 3) for m in range(5)]
    rest = [(k % 2, (START + dt.timedelta(days=k - 4)).date(), float(45 + 9 * (k % 2) + k)) for k in range(14)]
    frames = [
        spark.createDataFrame(sessions, "subject int, hae_id string, start_time timestamp, duration_s double, avg_hr double, max_hr double"),
        spark.createDataFrame(hr, "subject int, workout_hae_id string, ts timestamp, bpm double"), spark.createDataFrame(rest, "subject int, day date, value double"),
    ]
    both = training.session_impulse(*frames, "UTC")
    got = {(r.subject, r.hae_id): r.trimp for r in both.collect()}
    want = {(s, r.hae_id): r.trimp for s in (0, 1) for r in training.session_impulse(*[f.filter(F.col("subject") == s).drop("subject") for f in frames], "UTC").collect()}
    assert got == pytest.approx(want) and len(got) == 10
    assert training.daily_impulse(both).columns == ["subject", "day", "trimp"]
    with pytest.raises(ValueError):
        training.session_impulse(frames[0], frames[1], frames[2].drop("subject"), "UTC")


def test_a_step_threshold_of_zero_asks_for_no_steps(spark):
    hr = spark.createDataFrame([(minutes(0), 90.0)], "ts timestamp, bpm double")
    steps = spark.createDataFrame([(minutes(0), 80.0)], "ts timestamp, steps double")
    none = lambda schema: spark.createDataFrame([], schema)
    state = lambda s: stress.timeline(hr, none("day date, rest double"), none("day date, hrv_z double"), none("start timestamp, end timestamp"), steps, "UTC", s, 190.0, 60.0).first().state
    assert state(C.Stress()) == "active" and state(C.Stress(steps_per_min=0.0)) != "active"


def test_alerts_have_notes_and_details(spark):
    day = dt.date(2024, 1, 1)
    days = spark.createDataFrame([(day, 71.26, 30, 40, 50, -1.23456), (day, 59.9, 1, 1, 1, None), (day, 60.0, 1, 2, 3, None)], "day date, score double, high_min int, medium_min int, rest_min int, hrv_z double")
    a, b = findings.stress_alerts(days, C.Stress()).orderBy(F.desc("severity")).collect()
    assert (a.note, a.severity, json.loads(a.details)) == ("elevated daily stress", 71.26, {"score": 71.3, "high_min": 30, "medium_min": 40, "rest_min": 50, "hrv_z": -1.2346})
    assert b.severity == 60.0 and json.loads(b.details).get("hrv_z") is None
    low = spark.createDataFrame([(day, 12, 80, 61, 44, 70), (day, 21, 80, None, 1, 1), (day, 20, 80, None, 1, 1)], "day date, low_level int, high_level int, wake_level int, charged int, drained int")
    a, b = findings.energy_alerts(low, C.Energy()).orderBy(F.desc("severity")).collect()
    assert (a.note, a.severity, json.loads(a.details)) == ("low energy reserve", 88.0, {"low_level": 12, "high_level": 80, "wake_level": 61, "charged": 44.0, "drained": 70.0}) and b.severity == 80.0


WHOLE = ["workout_duration", "workout_count", "workout_intensity"]


@pytest.mark.parametrize("metric, edwards, whole, sport", [
    ("both", True, ["workout_trimp", "workout_load", "workout_edwards"], ["workout_trimp_running", "workout_load_running", "workout_edwards_running", "workout_trimp_trail_run", "workout_load_trail_run"]),
    ("both", False, ["workout_trimp", "workout_load"], ["workout_trimp_running", "workout_load_running", "workout_trimp_trail_run", "workout_load_trail_run"]),
    ("energy", True, ["workout_load", "workout_edwards"], ["workout_load_running", "workout_edwards_running", "workout_load_trail_run"]),
    ("trimp", False, ["workout_trimp"], ["workout_trimp_running", "workout_trimp_trail_run"]),
])
def test_workout_series_names(spark, metric, edwards, whole, sport):
    columns = "day date, trimp double, load double, edwards double, duration_h double, count long, intensity double"
    d = [dt.date(2024, 1, k) for k in (1, 3, 4)]
    rows = [(d[0], 5.0, 100.0, 7.0, 1.0, 1, 3.0), (d[1], 6.0, 90.0, 0.0, 0.5, 2, None), (d[2], 0.0, 80.0, 0.0, 0.5, 1, 4.0)]
    by_type = spark.createDataFrame([("running", *rows[0]), ("Trail Run", *rows[1]), (None, *rows[2])], "canonical_type string, " + columns)
    got = series.workouts(spark.createDataFrame(rows, columns), by_type, metric, edwards).collect()
    assert {r.series for r in got} == {*WHOLE, *whole, *sport}
    value = {(r.series, r.day.day): r.value for r in got}
    assert value["workout_count", 2] == 0.0 and value["workout_intensity", 2] is None and value["workout_intensity", 3] is None and value["workout_duration", 4] == 0.5


def test_no_intensity_no_series(spark):
    row = [(dt.date(2024, 1, 1), 5.0, 100.0, 0.0, 1.0, 1, None)]
    columns = "day date, trimp double, load double, edwards double, duration_h double, count long, intensity double"
    both = spark.createDataFrame(row, columns)
    assert {r.series for r in series.workouts(both, both.withColumn("canonical_type", F.lit(None).cast("string"))).collect()} == {"workout_trimp", "workout_load", "workout_duration", "workout_count"}


def test_energies_in_unknown_units(spark):
    uuid = "00000000-0000-0000-0000-00000000000"
    energy_of = lambda total, active: {"totalEnergy": total, "activeEnergyBurned": active}
    cases = [
        (energy_of({"qty": 10, "units": "kJ"}, {"qty": 10, "units": "kcal"}), 0), (energy_of({"qty": 10, "units": "BTU"}, {"qty": 10, "units": "kJ"}), 1), (energy_of({"qty": 1, "units": "BTU"}, {"qty": 1, "units": "Wh"}), 2),
        (energy_of({"qty": 10, "units": ""}, 12), 0), (energy_of({"qty": None, "units": "BTU"}, None), 0),
    ]
    body = json.dumps({"data": {"workouts": [{"id": f"{uuid}{k}", "name": "Run", **c} for k, (c, _) in enumerate(cases)]}})
    rows, _ = payload.workouts(spark.createDataFrame([(body,)], "body string"))
    assert {r.hae_id: r.energy_flags for r in rows.collect()} == {f"{uuid}{k}": n for k, (_, n) in enumerate(cases)}


@pytest.mark.parametrize("bad", [
    {"correlation": {"max_lag": 15}}, {"correlation": {"keep_alpha": 0.0}}, {"anomaly": {"window": 1}}, {"load": {"min_active_days": 29}}, {"load": {"metric": "km"}}, {"load": {"overreach": 0.1}}, {"stress": {"reserve_full": 0.0}},
    {"stress": {"window_days": 0}}, {"energy": {"neutral": 101}}, {"report": {"lookback_days": 91}}, {"report": {"language": "fr"}}, {"profile": {"hr_max": 300}}, {"profile": {"sex": "x"}}, {"anomaly": {"threshold": "high"}},
])
def test_settings_have_ranges(bad):
    with pytest.raises(ValueError):
        C.from_dict(bad)


def test_files_over_the_size_limit_are_left_out(spark, tmp_path):
    (tmp_path / "small.json").write_text("{}")
    (tmp_path / "large.json").write_text("{" + " " * 100 + "}")
    assert [r.body for r in payload.files(spark, str(tmp_path), most_bytes=50).collect()] == ["{}"]

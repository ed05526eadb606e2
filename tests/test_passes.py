"""The passes over stored tables, subjects kept apart, and the rules of the findings."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vitalgrid import config as C
from vitalgrid.operators import correlation, findings, narrate, passes, stress, training
from vitalgrid.plans.fixtures import ZONE, Tables
from vitalgrid.sources import payload

FOLDER = "/root/testdata/sf0.001"
CONFIG = C.Config(zone=ZONE, stress=C.Stress(min_measured=1), energy=C.Energy(min_measured=1))


def rows(df):
    return sorted(map(str, (tuple(sorted(r.asDict().items(), key=lambda x: x[0])) for r in df.collect())))


def test_subjects_are_kept_apart(spark, tmp_path):
    t = Tables(spark, FOLDER)
    samples, sessions, asleep = (f(2).cache() for f in (t.vital_samples, t.vital_workouts, t.vital_sleep))
    buckets, days = passes.stress_pass(samples, sessions, CONFIG)
    buckets.write.parquet(f"{tmp_path}/buckets")  # the passes read stored tables
    buckets = spark.read.parquet(f"{tmp_path}/buckets")
    levels, energy_days = passes.energy_pass(buckets, asleep, CONFIG)
    for who in (0, 1):
        own = lambda df: df.filter(F.col("subject") == who).drop("subject")
        b, d = passes.stress_pass(own(samples), own(sessions), CONFIG)
        lv, e = passes.energy_pass(own(buckets), own(asleep), CONFIG)
        assert d.count() > 0 and e.count() > 0
        for whole, part in ((buckets, b), (days, d), (levels, lv), (energy_days, e)):
            assert rows(own(whole)) == rows(part)
    with pytest.raises(ValueError):
        stress.inside(samples.withColumnRenamed("time", "ts"), t.intervals())


def test_a_window_gives_the_rows_of_the_whole_and_a_second_refresh_changes_nothing(spark, tmp_path):
    t = Tables(spark, FOLDER)
    tables = {"metric_samples": t.vital_samples(), "workouts": t.vital_workouts(), "sleep_intervals": t.vital_sleep()}
    whole, _ = passes.stress_pass(tables["metric_samples"], tables["workouts"], CONFIG)
    part, _ = passes.stress_pass(tables["metric_samples"], tables["workouts"], CONFIG, since_days=3)
    assert 0 < part.count() < whole.count() and set(rows(part)) <= set(rows(whole))
    assert part.select("day").distinct().count() <= 3
    once = passes.refresh(tables.__getitem__, CONFIG, str(tmp_path), since_days=5)
    read = lambda: {n: rows(spark.read.parquet(f"{tmp_path}/{n}")) for n in ("stress_intraday", "stress_daily", "battery_intraday", "battery_daily")}
    first = read()
    assert once["stress"] >= 1 and all(first.values())
    assert passes.refresh(tables.__getitem__, CONFIG, str(tmp_path), since_days=5) == once and read() == first


def test_neutral_level_is_the_set_one_else_the_default(spark):
    t = Tables(spark, FOLDER)
    buckets, _ = passes.stress_pass(t.vital_samples(), t.vital_workouts(), CONFIG)
    assert passes.neutral_level(buckets, t.vital_sleep(), C.Energy(neutral=31.0)).collect()[0].neutral == 31.0
    assert passes.neutral_level(buckets, t.vital_sleep(), C.Energy()).collect()[0].neutral == 25.0  # under 1440 rows awake


def loads(spark, names, values):
    day = dt.date(2024, 1, 1)
    return spark.createDataFrame([(n, day + dt.timedelta(days=i), float(v)) for n in names for i, v in enumerate(values)], "series string, day date, value double")


def test_training_status_is_one_finding_of_the_whole(spark):
    both = loads(spark, ["workout_trimp", "workout_load", "workout_trimp_running"], [20.0] * 200 + [24.0] * 14)
    found = findings.training_status(both).collect()
    assert [r.metric_a for r in found] == ["workout_trimp"] and found[0].note == "productive training (moderate negative form)"
    assert '"zone":"productive"' in found[0].details and '"ctl_trend":"rising"' in found[0].details
    assert [r.metric_a for r in findings.training_status(both.filter("series <> 'workout_trimp'")).collect()] == ["workout_load"]
    assert findings.training_status(both.filter("series = 'workout_trimp_running'")).count() == 0
    level = training.training_status(training.smoothed(loads(spark, ["workout_trimp"], [20.0] * 300))).first()
    assert level.ctl_trend == "flat"
    short = findings.training_status(loads(spark, ["workout_trimp"], [20.0] * 45)).first()
    assert "ctl_ago" in short.details or "ctl_trend" not in short.details
    spike = findings.training_load(loads(spark, ["workout_trimp"], [10.0] * 56 + [60.0] * 7), C.Load()).first()
    assert spike.note == "training load spike (acute load high vs. chronic)"


def test_recovery_counts_from_the_last_paired_day(spark):
    day = dt.date(2024, 1, 1)
    data = []
    for i in range(60):
        odd = i == 50
        data += [("resting_heart_rate", day + dt.timedelta(days=i), (80.0 if odd else 50.0 + i % 3)), ("heart_rate_variability", day + dt.timedelta(days=i), (10.0 if odd else 60.0 + i % 3))]
    data += [("resting_heart_rate", day + dt.timedelta(days=i), 50.0 + i % 3) for i in range(60, 120)]  # one series goes on alone
    found = findings.recovery(spark.createDataFrame(data, "series string, day date, value double"), C.Recovery()).collect()
    assert [r.ref_date for r in found] == [day + dt.timedelta(days=50)] and found[0].note == "low HRV and high resting HR"


def test_families_and_bands():
    assert [narrate.z_label(z) for z in (1.4, -1.5, 2.5, -3.5)] == ["normal", "mildly notable", "clearly outside normal range", "strong outlier"]
    assert [narrate.acwr_zone(r) for r in (0.7, 0.8, 1.3, 1.4, 1.6)] == ["undertraining zone", "optimal zone", "optimal zone", "caution zone", "high overtraining risk"]
    assert narrate.acwr_zone(1.6, "de") == "hohes Übertrainingsrisiko"
    assert "body_temperature" in correlation.VITAL and "resting_heart_rate" in correlation.HR_RATE and "cardio_recovery" in correlation.AUTONOMIC


def test_a_points_own_unit_wins_and_the_later_of_equal_keys_counts(spark):
    body = '{"data":{"metrics":[{"name":"weight_body_mass","units":"kg","data":[{"date":"2024-01-01 08:00:00 +0100","qty":150,"units":"lb"},{"date":"2024-01-02 08:00:00 +0100","qty":70,"units":""}]}],"workouts":[{"id":"00000000-0000-0000-0000-000000000001","name":"Run","start":"2024-01-01 08:00:00 +0100","end":"2024-01-01 09:00:00 +0100","heartRateData":[{"date":"2024-01-01 08:01:00 +0100","Avg":100},{"date":"2024-01-01 08:01:00 +0100","Avg":120}]}]}}'
    bodies = spark.createDataFrame([("a", body)], "_path string, body string")
    units = [r.unit for r in payload.samples(payload.metric_points(bodies)).orderBy("time").collect()]
    assert units == ["lb", "kg"]
    sessions, _ = payload.workouts(bodies)
    seqs = sorted((r.seq.at, r.bpm) for r in payload.hr_samples(sessions).collect())
    assert seqs == [(0, 100.0), (1, 120.0)]


def test_a_run_of_all_kinds(spark, tmp_path):
    t = Tables(spark, FOLDER)
    n = iter(range(100))

    def written(df, name):
        path = f"{tmp_path}/{name}{next(n)}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    day = dt.date(2024, 1, 1)
    values = [("workout_trimp", day + dt.timedelta(days=i), 20.0 + 40.0 * (i > 60)) for i in range(70)] + [("step_count", day + dt.timedelta(days=i), 1000.0 + i * 37 % 100 + 9000.0 * (i == 69)) for i in range(70)]
    regular = spark.createDataFrame([("bedtime", 2.0, day, day)], "series string, std_hours double, window_start date, window_end date")
    _, days = passes.stress_pass(t.vital_samples(), t.vital_workouts(), CONFIG)
    found, failed = passes.run(spark.createDataFrame(values, "series string, day date, value double"), regular, CONFIG, written, stress_days=days)
    assert failed == {}
    kinds = {r.kind for r in found.collect()}
    assert {"anomaly", "training_status", "training_load", "consistency"} <= kinds

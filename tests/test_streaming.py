import datetime as dt
import json
import shutil

import pytest
from pyspark.sql import functions as F

from vitalgrid.__main__ import main
from vitalgrid.operators import audit, findings, narrate
from vitalgrid.schema import registry
from vitalgrid.sources import merge, payload
from vitalgrid.streaming import landing
from tests.test_operators import BODY


def test_landing_folder_is_idempotent(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(BODY))
    (folder / "bad.json").write_text("{")
    store = landing.Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        landing.stream(spark, str(folder), store, str(tmp_path / "ck")).awaitTermination()
    before = sorted(map(str, store.read("metric_samples").drop("seq").collect()))
    assert store.read("raw_ingest").count() == 1 and store.read("workouts").count() == 1 and len(before) == 3
    bodies = spark.createDataFrame([("again", json.dumps(BODY))], "path string, body string")
    assert landing.ingest(store, bodies)["new"] == 0
    changed = json.loads(json.dumps(BODY))
    changed["data"]["metrics"][0]["data"][0]["Avg"] = 63
    counts = landing.ingest(store, spark.createDataFrame([("new", json.dumps(changed))], "path string, body string"))
    assert (counts["new"], counts["implausible"], counts["dropped_workouts"]) == (1, 1, 1)
    assert store.read("metric_samples").filter("metric = 'heart_rate'").first().vavg == 63 and store.read("metric_samples").count() == 3
    assert store.read("metric_registry").filter("metric = 'brand_new' and tier = 'secondary' and agg = 'sum'").count() == 1
    assert landing.rederive_hr(store, dry_run=True) == landing.rederive_hr(store) == 2


def test_dry_run_stores_nothing(spark, tmp_path):
    store = landing.Store(spark, str(tmp_path / "store"))
    bodies = spark.createDataFrame([("a", json.dumps(BODY)), ("b", "{")], "path string, body string")
    dry = landing.ingest(store, bodies, dry_run=True)
    assert store.read("raw_ingest") is None and store.read("metric_samples") is None and landing.rederive_hr(store) == 0
    done = landing.ingest(store, bodies)
    assert {k: done[k] for k in dry} == dry and (dry["files"], dry["bad"], dry["new"]) == (2, 1, 1) and not [k for k in dry if k.endswith("_stored")]


def test_counts_come_from_the_writes(spark, tmp_path):
    store = landing.Store(spark, str(tmp_path / "store"))
    first = landing.ingest(store, spark.createDataFrame([("a", json.dumps(BODY))], "path string, body string"))
    of = lambda counts, table: (counts[f"{table}_stored"], counts[f"{table}_new"])
    assert of(first, "metric_samples") == (3, 3) and of(first, "sleep_sessions") == (1, 1) and of(first, "workouts") == (1, 1) and of(first, "workout_hr_samples") == (2, 2)
    assert first["unknown_metrics"] == 1
    more = json.loads(json.dumps(BODY))
    more["data"]["metrics"][1]["data"].append({"date": "2024-05-03 10:00:00 +0200", "qty": 5})  # one new sample, the others again
    more["data"]["metrics"][3]["data"][0]["totalSleep"] = 1.0  # emptier than what is stored
    second = landing.ingest(store, spark.createDataFrame([("b", json.dumps(more))], "path string, body string"))
    assert of(second, "metric_samples") == (4, 1) and of(second, "sleep_sessions") == (0, 0) and of(second, "workouts") == (1, 0) and of(second, "workout_hr_samples") == (2, 0)
    assert second["unknown_metrics"] == 0
    bare = landing.ingest(store, spark.createDataFrame([("c", '{"data": {}}')], "path string, body string"))
    assert bare["new"] == 1 and all(v == 0 for k, v in bare.items() if k.endswith(("_stored", "_new")))


def test_a_body_is_parsed_once(spark):
    bodies = spark.createDataFrame([(json.dumps(BODY),)], "body string")
    for frame in (payload.samples(payload.metric_points(bodies)), payload.workouts(bodies)[0], audit.census(bodies)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.lower().count("parse_json(") + plan.lower().count("parsejson(") <= 1 and "get_json_object" not in plan.lower()


def test_a_replacement_survives_a_crash(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(dt.date(2024, 1, d), d) for d in (1, 2, 3, 4)], "day date, v int")
    rows.write.partitionBy("day").parquet(path)
    read = lambda: sorted((r.day.day, r.v) for r in spark.read.schema("v int, day date").parquet(path).collect())
    new = rows.filter("v in (2, 4)").withColumn("v", F.col("v") * 10)
    real, calls = merge.complete, []

    def stop(spark, at):
        calls.append(at)
        if len(calls) == 2:
            raise RuntimeError("stopped behind the marker")
        real(spark, at)

    monkeypatch.setattr(merge, "complete", stop)
    for half in (False, True):
        calls.clear()
        with pytest.raises(RuntimeError):
            merge.replace_window(path, new, "day", "2024-01-02", "2024-01-04")
        if half:  # some days are moved already
            staged = next(p for p in (tmp_path / "t").iterdir() if p.name.startswith("_staged-"))
            (tmp_path / "t" / "_replacing-days").write_text(json.dumps(["day=2024-01-02", "day=2024-01-04"]))
            shutil.rmtree(tmp_path / "t" / "day=2024-01-02")
            (staged / "day=2024-01-02").rename(tmp_path / "t" / "day=2024-01-02")
        real(spark, path)
        assert read() == [(1, 1), (2, 20), (4, 40)]
        assert not [p.name for p in (tmp_path / "t").iterdir() if p.name.startswith(("_staged", "_replacing"))]
    calls.clear()
    new.write.partitionBy("day").parquet(f"{path}/_staged-old")  # staged, but never marked
    monkeypatch.setattr(merge, "complete", real)
    merge.replace_window(path, new.limit(0), "day", "2024-01-03", "2024-01-04")
    assert read() == [(1, 1), (2, 20)] and not (tmp_path / "t" / "_staged-old").exists()


def _points(spark, *rows):
    return spark.createDataFrame(rows, "metric string, time string, source string, qty double, seq int").withColumn("time", F.col("time").cast("timestamp"))


def test_a_merge_writes_the_days_it_touches(spark, tmp_path):
    store = landing.Store(spark, str(tmp_path))
    store.upsert("metric_samples", _points(spark).limit(0))
    assert store.read("metric_samples").count() == 0
    days = ["2024-01-01 23:59:59", "2024-01-02 00:00:00", "1969-12-31 23:00:00"]
    store.upsert("metric_samples", _points(spark, *[("m", d, "", 1.0, 1) for d in days]))
    before = store._days("metric_samples", store._versions("metric_samples"))
    store.upsert("metric_samples", _points(spark, ("m", days[1], "", 2.0, 1), ("m", days[1], "", 3.0, 2), ("m", "2024-01-03 10:00:00", "", 4.0, 1)))
    after = store._days("metric_samples", store._versions("metric_samples"))
    assert {d for d in after if before.get(d) != after[d]} == {"utc_day=2024-01-02", "utc_day=2024-01-03"}
    got = sorted((str(r.time), r.qty) for r in store.read("metric_samples").collect())
    assert got == sorted([(days[0], 1.0), (days[1], 3.0), (days[2], 1.0), ("2024-01-03 10:00:00", 4.0)])
    for n in range(4):  # the state before the last stays readable, older ones go
        old = store.read("metric_samples")
        store.upsert("metric_samples", _points(spark, ("m", days[1], "", 10.0 + n, 1)))
        assert old.filter(F.col("time") == F.lit(days[1]).cast("timestamp")).first().qty == (3.0 if n == 0 else 9.0 + n)
    assert len(store._versions("metric_samples")) <= 4 and store.read("metric_samples").count() == 4


def test_commands_over_a_store(spark, tmp_path, capsys):
    (tmp_path / "a.json").write_text(json.dumps(BODY))
    at = [str(tmp_path / "store")]
    main([*at, "backfill", str(tmp_path), str(tmp_path / "a.json")], spark)
    assert "'files': 1" in capsys.readouterr().out
    states = []
    for _ in range(2):
        main([*at, "analyze"], spark)
        assert capsys.readouterr().out == "ok\n"
        states.append(sorted(map(str, spark.read.parquet(f"{at[0]}/derived/workout_load_daily").drop("computed_at").collect())))
    assert states[0] == states[1] and any("workout_trimp'" in x for x in states[0])
    assert spark.read.parquet(f"{at[0]}/derived/findings_history").select("computed_at").distinct().count() == (2 if spark.read.parquet(f"{at[0]}/derived/findings").count() else 0)
    main([*at, "audit"], spark)
    out = capsys.readouterr().out
    assert all(x in out for x in ("coverage", "units", "unmapped", "last_run", "heart_rate"))
    main([*at, "check-workout-hr", "--limit", "1"], spark)
    assert "heartRateData" in capsys.readouterr().out
    for _ in range(2):  # again changes nothing
        main([*at, "rederive", "--since-days", "2"], spark)
        states.append((capsys.readouterr().out, sorted(map(str, spark.read.parquet(f"{at[0]}/derived/stress_intraday").collect()))))
    assert states[-1] == states[-2] and "'stress'" in states[-1][0]
    main([*at, "narrate", str(tmp_path / "text")], spark)
    assert capsys.readouterr().out.strip().endswith(".md")


def test_labels_and_standing_kinds(spark):
    rows = [("trend", "step_count", None, "2020-01-01"), ("anomaly", "workout_trimp_trail_run", "vo2_max", "2024-01-05"), ("anomaly", "heart_rate", None, "2020-01-01"), ("stress", "odd_one", "bedtime", "2024-01-05")]
    df = spark.createDataFrame(rows, "kind string, metric_a string, metric_b string, ref_date string").withColumn("ref_date", F.col("ref_date").cast("date"))
    got = {r.metric_a: (r.metric_a_label, r.metric_b_label) for r in narrate.labelled(narrate.current(df, dt.date(2024, 1, 1)), narrate.labels(registry(spark))).collect()}
    assert got == {"step_count": ("Steps", None), "workout_trimp_trail_run": ("Training Load (TRIMP) — Trail Run", "VO2 Max"), "odd_one": ("odd_one", "Bedtime")}


def test_report_has_sections_in_order(spark, tmp_path):
    rows = spark.createDataFrame([("a", "b", i, 0.5 - i / 100) for i in range(4)], "a string, b string, lag int, coef double")
    f = findings.finding(rows, "correlation", {"n": F.lit(50), "priority_tier": F.lit(2)}, metric_a=F.col("a"), metric_b=F.col("b"), lag_days=F.col("lag"), coefficient=F.col("coef"), severity=F.col("coef"))
    g = findings.finding(rows.limit(1), "stress", {"score": F.lit(80.0)}, metric_a=F.lit("stress"), ref_date=F.lit("2024-01-01").cast("date"), severity=F.lit(80.0))
    text = narrate.context(f.unionByName(g), 7, dt.date(2024, 1, 2), max_correlations=2)
    assert text.index("## Stress") < text.index("## Correlations") and "+2 more" in text and "(high)" in text
    assert open(narrate.write_report(text, str(tmp_path), dt.date(2024, 1, 2))).read() == text


def test_every_kind_is_told_in_both_languages(spark):
    day = dt.date(2024, 1, 2)
    cases = [  # kind, name, details, note, words in English and German
        ("recovery_alert", "recovery", {"heart_rate_variability_z": -2.0, "resting_heart_rate_z": 1.7, "short_sleep": True}, "low HRV", ["HRV z -2.00 (mildly notable), below baseline", "RHR z 1.70", "short sleep too – low HRV"], ["unter Baseline", "auch kurzer Schlaf"]),
        ("training_status", "workout_trimp", {"ctl": 50.0, "atl": 44.0, "tsb": 6.0, "tsb_pct": 0.12, "zone": "fresh", "ctl_trend": "rising", "ctl_trend_days": 28}, "x", ["fitness CTL 50.0, fatigue ATL 44.0", "form TSB +6.0 (+12 % CTL)", "fresh / tapered", "fitness trend 28 d: rising"], ["Ermüdung ATL 44.0", "Fitness-Trend 28 d: steigend"]),
        ("training_load", "workout_load", {"ratio": 1.62, "acute": 10.0, "chronic": 6.2}, "spike", ["ACWR 1.62 (high overtraining risk)", "acute 10.00, chronic 6.20 – spike"], ["akut 10.00, chronisch 6.20"]),
        ("stress", "stress", {"score": 71.3, "high_min": 30, "hrv_z": -2.6}, "elevated daily stress", ["score 71 (medium)", "30 minutes of high stress", "HRV z -2.60 (clearly outside normal range) – elevated daily stress"], ["Score 71 (mittel)"]),
        ("body_battery", "body_battery", {"low_level": 12, "wake_level": 60, "high_level": 80, "drained": 44.0, "charged": 70.0}, "low energy reserve", ["lowest 12, at waking 60, highest 80, drained 44, charged 70 – low energy reserve"], ["Tief 12, beim Aufwachen 60, Hoch 80, entladen 44, geladen 70"]),
        ("anomaly", "step_count", {"z": 4.0, "global_z": 3.0, "value": 12.0}, None, ["Steps: z 4.00 (strong outlier), over all days 3.00, value 12.0"], ["über alle Tage 3.00, Wert 12.0"]),
        ("consistency", "bedtime", {"std_hours": 1.25}, "irregular bedtime", ["Bedtime: σ 1.25 h – irregular bedtime"], ["σ 1.25 h"]),
        ("trend", "step_count", {"slope_per_day": 0.5, "strength": 0.8}, None, ["Steps (2024-01-02 – 2024-01-02): +0.5000 a day, strength 0.80"], ["+0.5000 pro Tag, Stärke 0.80"]),
        ("seasonality", "step_count", {"peak_month": 7, "trough_month": 12, "strength": 0.4, "phase_confident": False}, None, ["peak July, trough December, strength 0.40, phase uncertain"], ["Hochpunkt Juli, Tiefpunkt Dezember", "Phase unsicher"]),
        ("correlation", "step_count", {"n": 90}, None, ["Steps → Total Sleep: after 2 d, r 0.512, p 0.0100, n 90"], ["nach 2 d, r 0.512"]),
    ]
    rows = [(k, m, "sleep_total_h" if k == "correlation" else None, json.dumps(d), note, 2, 0.51234, 0.01, 5.0) for k, m, d, note, *_ in cases]
    frame = spark.createDataFrame(rows, "k string, m string, b string, d string, note string, lag int, c double, p double, s double")
    dated = F.col("k").isin("recovery_alert", "training_status", "training_load", "stress", "body_battery", "anomaly")
    when = F.when(dated, F.lit(day))
    f = frame.select(
        F.col("k").alias("kind"), F.col("m").alias("metric_a"), F.col("b").alias("metric_b"), F.col("lag").alias("lag_days"), F.col("c").alias("coefficient"), F.lit(None).cast("double").alias("p_value"), F.col("p").alias("p_value_adj"),
        when.alias("ref_date"), F.lit(day).alias("window_start"), F.lit(day).alias("window_end"), F.col("s").alias("severity"), F.col("d").alias("details"), "note")
    for language, at in (("en", 4), ("de", 5)):
        text = narrate.context(f, 7, day, language)
        assert [w for c in cases for w in c[at] if w not in text] == []
        bare = narrate.context(f.limit(0), 7, day, language)
        assert bare.count("- –") == len(narrate.SECTIONS) == text.count("## ")

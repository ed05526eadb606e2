"""A sectioned text of current findings: the one place where a bounded snapshot is read row by row on the driver."""

from __future__ import annotations

import json
from datetime import date, timedelta
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.operators.correlation import priority
from vitalgrid.schema import registry

# The sections in order, with their headings.
SECTIONS = [
    ("recovery_alert", "Recovery alerts", "Erholungswarnungen"), ("training_status", "Training status", "Trainingszustand"), ("training_load", "Training load", "Trainingslast"),
    ("stress", "Stress", "Stress"), ("body_battery", "Energy reserve", "Energiereserve"), ("anomaly", "Anomalies", "Auffälligkeiten"),
    ("consistency", "Sleep regularity", "Schlafregelmäßigkeit"), ("trend", "Trends", "Trends"), ("seasonality", "Seasonality", "Saisonalität"), ("correlation", "Correlations", "Zusammenhänge"),
]


# Kinds shown only within the lookback; all other kinds stand until the next run.
DATED = ("anomaly", "recovery_alert", "training_load", "stress", "body_battery")
# Labels of metrics that are not their names in words.
METRIC_LABELS = {
    "step_count": "Steps", "apple_exercise_time": "Exercise Time", "walking_running_distance": "Walking + Running Distance", "apple_stand_time": "Stand Time",
    "apple_sleeping_wrist_temperature": "Sleeping Wrist Temperature", "time_in_daylight": "Time in Daylight", "vo2_max": "VO2 Max", "weight_body_mass": "Body Mass",
    "walking_asymmetry_percentage": "Walking Asymmetry", "walking_double_support_percentage": "Double Support", "six_minute_walking_test_distance": "Six-Minute Walking Test Distance",
    "basal_energy_burned": "Basal Energy", "apple_stand_hour": "Stand Hours", "atrial_fibrillation_burden": "AFib History", "swimming_stroke_count": "Swimming Strokes",
    "handwashing": "Handwashing Duration", "dietary_water": "Water Intake",
}
# Labels of series without a registry row; of the loads there are more by sport.
LOAD_LABELS = {"workout_trimp": "Training Load (TRIMP)", "workout_load": "Training Load", "workout_edwards": "Training Load (Edwards TRIMP)"}
SERIES_LABELS = LOAD_LABELS | {
    "sleep_total_h": "Total Sleep", "sleep_deep_h": "Deep Sleep", "sleep_rem_h": "REM Sleep", "sleep_efficiency": "Sleep Efficiency",
    "bedtime": "Bedtime", "recovery": "Recovery", "stress": "Stress", "body_battery": "Body Battery",
}


def labels(registry: DataFrame) -> DataFrame:
    """(metric, display_name) of the registered metrics."""
    given = F.create_map(*[F.lit(x) for pair in METRIC_LABELS.items() for x in pair])
    return registry.select("metric", F.coalesce(given[F.col("metric")], F.initcap(F.regexp_replace("metric", "_", " "))).alias("display_name"))


def labelled(findings: DataFrame, names: DataFrame) -> DataFrame:
    """``findings`` with ``metric_a_label`` and ``metric_b_label``: the name in ``names`` (metric, display_name), else that of a series the
    analysis makes itself, else the series' own name.
    """
    known = F.create_map(*[F.lit(x) for pair in SERIES_LABELS.items() for x in pair])
    out = findings
    for side in ("metric_a", "metric_b"):
        own = names.select(F.col("metric").alias("_m"), F.col("display_name").alias("_n"))
        key = F.col(side)
        sport = F.concat(known[F.regexp_extract(key, "^(workout_(?:trimp|load|edwards))_.", 1)], F.lit(" — "), F.initcap(F.regexp_replace(F.regexp_replace(key, "^workout_(trimp|load|edwards)_", ""), "_", " ")))
        out = out.join(F.broadcast(own), key == F.col("_m"), "left").withColumn(f"{side}_label", F.coalesce("_n", known[key], sport, key)).drop("_m", "_n")
    return out


def current(findings: DataFrame, cutoff) -> DataFrame:
    """Findings of the dated kinds from ``cutoff`` on, and all of the others."""
    return findings.filter((F.col("kind").isin(*DATED) & (F.col("ref_date") >= F.lit(cutoff).cast("date"))) | ~F.col("kind").isin(*DATED))


# Bands with their words, English and German.
Z_BANDS = [(1.5, "normal", "normal"), (2.5, "mildly notable", "leicht auffällig"), (3.5, "clearly outside normal range", "deutlich außerhalb Normalbereich"), (float("inf"), "strong outlier", "starker Ausreißer")]
ACWR_LOW, ACWR_BEST, ACWR_CAUTION = 0.8, 1.3, 1.5
ACWR_ZONES = {"low": ("undertraining zone", "Untertrainingszone"), "best": ("optimal zone", "optimale Zone"), "caution": ("caution zone", "Vorsichtszone"), "high": ("high overtraining risk", "hohes Übertrainingsrisiko")}
TSB_ZONES = {
    "detraining": ("detraining - load well below fitness", "Detraining – Belastung weit unter Fitnessniveau"), "fresh": ("fresh / tapered", "frisch / erholt (Taper)"),
    "neutral": ("neutral - load matches fitness", "neutral – Belastung entspricht Fitnessniveau"), "productive": ("productive training", "produktives Training"), "overreaching_risk": ("overreaching risk", "Überlastungsrisiko"),
}


def z_label(z: float, language: str = "en") -> str:
    """The band of a score's size, either way."""
    return next(words[language == "de"] for limit, *words in Z_BANDS if abs(z) < limit)


def acwr_zone(ratio: float, language: str = "en") -> str:
    zone = "low" if ratio < ACWR_LOW else "best" if ratio <= ACWR_BEST else "caution" if ratio <= ACWR_CAUTION else "high"
    return ACWR_ZONES[zone][language == "de"]


# Bands of the day's stress score.
STRESS_BANDS = [(25.0, "rest", "Ruhe"), (50.0, "low", "niedrig"), (75.0, "medium", "mittel"), (float("inf"), "high", "hoch")]
# How the fitness moves over four weeks.
FITNESS = {"rising": ("rising", "steigend"), "flat": ("flat", "gleichbleibend"), "falling": ("falling", "fallend")}
MONTHS = {
    "en": "January February March April May June July August September October November December".split(),
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
}


def stress_zone(score: float, language: str = "en") -> str:
    return next(words[language == "de"] for limit, *words in STRESS_BANDS if score < limit)


def select_findings(findings: DataFrame, lookback_days: int, as_of: date, max_correlations: int = 15) -> tuple[list, int]:
    """Rows of the lookback (dated kinds) and all standing ones, sorted; the correlations beyond the cap are counted, not shown."""
    tier = F.coalesce(F.get_json_object("details", "$.priority_tier").cast("int"), F.lit(1))
    df = labelled(current(findings, as_of - timedelta(days=lookback_days)), labels(registry(findings.sparkSession))).withColumn("_p", F.when(F.col("kind") == "correlation", priority(tier, F.col("coefficient"), F.coalesce("lag_days", F.lit(0)))))
    other = df.filter("kind <> 'correlation'").orderBy("kind", F.desc_nulls_last("ref_date"), F.desc_nulls_last("severity")).collect()
    pairs = df.filter("kind = 'correlation'")
    first = pairs.orderBy(F.desc("_p"), "metric_a", "metric_b")
    shown = (first.limit(max_correlations) if max_correlations else first).collect()  # of a snapshot, so bounded by the pairs of series
    return other + shown, pairs.count() - len(shown)


def _number(value, digits: int, sign: bool = False) -> str:
    return "n/a" if value is None else f"{value:{'+' if sign else ''}.{digits}f}"


def _said(kind: str, row, d: dict, de: bool) -> list[str]:
    """What a finding says beside its name, day and note, in parts; parts that a finding has no figures for are left out."""
    word = lambda english, german: german if de else english
    language = "de" if de else "en"
    band = lambda z: f"{_number(z, 2)} ({z_label(z, language)})"
    has = lambda *names: all(d.get(n) is not None for n in names)
    if kind == "recovery_alert":
        parts = [f"HRV z {band(d['heart_rate_variability_z'])}, {word('below baseline', 'unter Baseline')}"] if has("heart_rate_variability_z") else []
        parts += [f"RHR z {band(d['resting_heart_rate_z'])}, {word('above baseline', 'über Baseline')}"] if has("resting_heart_rate_z") else []
        return parts + ([word("short sleep too", "auch kurzer Schlaf")] if d.get("short_sleep") else [])
    if kind == "training_status":
        parts = [f"{word('fitness', 'Fitness')} CTL {_number(d['ctl'], 1)}, {word('fatigue', 'Ermüdung')} ATL {_number(d['atl'], 1)}"] if has("ctl", "atl") else []
        parts += [f"{word('form', 'Form')} TSB {_number(d['tsb'], 1, True)}" + (f" ({100 * d['tsb_pct']:+.0f} % CTL)" if has("tsb_pct") else "")] if has("tsb") else []
        parts += [TSB_ZONES[d["zone"]][de]] if d.get("zone") in TSB_ZONES else []
        return parts + ([f"{word('fitness trend', 'Fitness-Trend')} {d.get('ctl_trend_days', 28)} d: {FITNESS[d['ctl_trend']][de]}"] if d.get("ctl_trend") in FITNESS else [])
    if kind == "training_load":
        ratio = d.get("ratio", row["severity"])
        parts = [f"ACWR {_number(ratio, 2)}" + (f" ({acwr_zone(ratio, language)})" if ratio is not None else "")]
        return parts + ([f"{word('acute', 'akut')} {_number(d['acute'], 2)}, {word('chronic', 'chronisch')} {_number(d['chronic'], 2)}"] if has("acute", "chronic") else [])
    if kind == "stress":
        score = d.get("score", row["severity"])
        parts = [f"{word('score', 'Score')} {_number(score, 0)}" + (f" ({stress_zone(score, language)})" if score is not None else "")]
        parts += [f"{d['high_min']} {word('minutes of high stress', 'Minuten hoher Stress')}"] if has("high_min") else []
        return parts + ([f"HRV z {band(d['hrv_z'])}"] if has("hrv_z") else [])
    if kind == "body_battery":
        names = {"low_level": ("lowest", "Tief"), "wake_level": ("at waking", "beim Aufwachen"), "high_level": ("highest", "Hoch"), "drained": ("drained", "entladen"), "charged": ("charged", "geladen")}
        return [f"{words[de]} {_number(d[n], 0)}" for n, words in names.items() if has(n)]
    if kind == "anomaly":
        parts = [f"z {band(d['z'])}"] if has("z") else []
        parts += [f"{word('over all days', 'über alle Tage')} {_number(d['global_z'], 2)}"] if has("global_z") else []
        return parts + ([f"{word('value', 'Wert')} {d['value']}"] if has("value") else [])
    if kind == "consistency":
        return [f"σ {_number(d.get('std_hours', row['severity']), 2)} h"]
    if kind == "trend":
        return [f"{_number(d.get('slope_per_day'), 4, True)} {word('a day', 'pro Tag')}", f"{word('strength', 'Stärke')} {_number(d.get('strength', row['severity']), 2)}"]
    if kind == "seasonality":
        month = lambda n: MONTHS[language][n - 1] if n and 1 <= n <= 12 else "n/a"
        parts = [f"{word('peak', 'Hochpunkt')} {month(d.get('peak_month'))}", f"{word('trough', 'Tiefpunkt')} {month(d.get('trough_month'))}", f"{word('strength', 'Stärke')} {_number(d.get('strength', row['severity']), 2)}"]
        return parts + ([] if d.get("phase_confident", True) else [word("phase uncertain", "Phase unsicher")])
    lag = row["lag_days"] or 0
    return [f"{word('after', 'nach')} {lag} d" if lag else word("same day", "selber Tag"), f"r {_number(row['coefficient'], 3)}", f"p {_number(row['p_value_adj'], 4)}", f"n {d.get('n', '?')}"]


#: Kinds whose note adds to what the figures say.
NOTED = ("recovery_alert", "training_load", "stress", "body_battery", "consistency")


def _line(row, language: str = "en") -> str:
    """A finding in words: its day or window, its name (of a correlation both), its figures, its note."""
    d, kind = json.loads(row["details"]) if row["details"] else {}, row["kind"]
    span = f" ({row['window_start']} – {row['window_end']})" if kind == "trend" and row["window_start"] and row["window_end"] else ""
    name = f"{row['metric_a_label']} → {row['metric_b_label']}" if kind == "correlation" else f"{row['metric_a_label']}{span}"
    note = f" – {row['note']}" if kind in NOTED and row["note"] else ""
    return (f"{row['ref_date']} " if row["ref_date"] else "") + f"{name}: " + ", ".join(_said(kind, row, d, language == "de")) + note


def context(findings: DataFrame, lookback_days: int, as_of: date, language: str = "en", max_correlations: int = 15) -> str:
    """All sections in fixed order, a dash in those without findings; ``max_correlations`` of 0 shows all."""
    rows, more = select_findings(findings, lookback_days, as_of, max_correlations)
    out = [f"# {as_of}"]
    for kind, english, german in SECTIONS:
        own = [_line(r, language) for r in rows if r["kind"] == kind]
        days = f" ({f'letzte {lookback_days} Tage' if language == 'de' else f'last {lookback_days} days'})" if kind == "anomaly" else ""
        out += ["", f"## {german if language == 'de' else english}{days}", *[f"- {x}" for x in own or ["–"]]]
        if kind == "correlation" and more:
            out.append(f"- +{more} {'weitere' if language == 'de' else 'more'}")
    return "\n".join(out) + "\n"


def write_report(text: str, folder: str, as_of: date) -> str:
    path = Path(folder) / f"{as_of}.md"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)

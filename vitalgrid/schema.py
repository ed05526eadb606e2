"""The metric registry, workout groups and workout names, as small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Metric | unit | daily aggregate | category | tier | least | most.
REGISTRY = """
step_count|count|sum|activity|core|0|
active_energy|kcal|sum|activity|core|0|
apple_exercise_time|min|sum|activity|core|0|
walking_running_distance|km|sum|activity|core|0|
flights_climbed|count|sum|activity|core|0|
physical_effort|kcal/hr·kg|avg|activity|core|0|
apple_stand_time|min|sum|activity|core|0|
apple_sleeping_wrist_temperature|degC|avg|sleep|core|20|45
breathing_disturbances|count|sum|sleep|core|0|
time_in_daylight|min|sum|sleep|core|0|
heart_rate_variability|ms|avg|vital|core|0|1000
resting_heart_rate|count/min|min|vital|core|20|200
respiratory_rate|count/min|avg|vital|core|3|80
heart_rate|count/min|avg|vital|core|20|250
blood_oxygen_saturation|%|avg|vital|core|50|100
walking_heart_rate_average|count/min|avg|vital|core|20|250
vo2_max|ml/(kg·min)|avg|vital|core|5|120
weight_body_mass|kg|avg|vital|core|2|500
cardio_recovery|count/min|avg|vital|core|0|200
walking_speed|km/hr|avg|mobility|secondary||
walking_step_length|cm|avg|mobility|secondary||
walking_asymmetry_percentage|%|avg|mobility|secondary||
walking_double_support_percentage|%|avg|mobility|secondary||
stair_speed_up|m/s|avg|mobility|secondary||
stair_speed_down|m/s|avg|mobility|secondary||
six_minute_walking_test_distance|m|avg|mobility|secondary||
basal_energy_burned|kcal|sum|activity|secondary||
apple_stand_hour|count|sum|activity|secondary||
environmental_audio_exposure|dBASPL|avg|environment|secondary||
headphone_audio_exposure|dBASPL|avg|environment|secondary||
waist_circumference|cm|avg|vital|secondary||
height|m|avg|vital|secondary||
atrial_fibrillation_burden|%|avg|vital|secondary||
swimming_distance|m|sum|activity|secondary||
cycling_distance|km|sum|activity|secondary||
swimming_stroke_count|count|sum|activity|secondary||
handwashing|s|sum|activity|secondary||
mindful_minutes|min|sum|mindfulness|secondary||
dietary_water|mL|sum|nutrition|secondary||
"""

# Unit conversions (from, to, factor).
CONVERSIONS = [("kJ", "kcal", 0.2390057361), ("kcal", "kJ", 1.0 / 0.2390057361)]

# Workout type, display group, order.
GROUPS = [
    ("running", "Cardio", 10), ("elliptical", "Cardio", 11), ("rowing", "Cardio", 12), ("hiit", "Cardio", 13),
    ("mixed_cardio", "Cardio", 14), ("stair_stepper", "Cardio", 15), ("walking", "Walking", 20), ("hiking", "Walking", 21),
    ("cycling", "Cycling", 30), ("strength", "Strength", 40), ("core", "Strength", 41), ("swimming", "Swimming", 50),
    ("yoga", "Mind & Body", 60), ("pilates", "Mind & Body", 61), ("dance", "Mind & Body", 62), ("cooldown", "Mind & Body", 63),
]

# The names that stand for each workout type.
NAMES = {
    "running": ["running", "outdoor run", "indoor run", "trail running", "laufen", "laufen outdoor", "laufen indoor", "outdoor-lauf", "indoor-lauf", "lauf"],
    "walking": ["walking", "outdoor walk", "indoor walk", "gehen", "gehen outdoor", "gehen indoor", "spazieren", "spaziergang", "outdoor spaziergang", "indoor spaziergang", "outdoor-spaziergang", "indoor-spaziergang"],
    "hiking": ["hiking", "wandern"],
    "cycling": ["cycling", "outdoor cycle", "indoor cycle", "rad outdoor", "rad indoor", "radfahren", "outdoor radfahren", "indoor radfahren", "innenräume radfahren", "outdoor-radfahren", "indoor-radfahren"],
    "strength": ["traditional strength training", "functional strength training", "strength training", "krafttraining", "traditionelles krafttraining", "klassisches krafttraining", "funktionelles krafttraining"],
    "core": ["core training", "core-training"],
    "swimming": ["swimming", "pool swim", "open water swim", "schwimmen", "beckenschwimmen", "freiwasserschwimmen", "schwimmbad schwimmen", "freiwasser schwimmen"],
    "elliptical": ["elliptical", "crosstrainer", "elliptisch"],
    "rowing": ["rowing", "rudern", "rudern outdoor", "rudern indoor"],
    "stair_stepper": ["stair stepper", "stepper", "steppertraining", "treppensteigen"],
    "hiit": ["high intensity interval training", "hiit", "hochintensives intervalltraining"],
    "mixed_cardio": ["mixed cardio", "gemischtes cardio", "gem. cardiotraining"],
    "yoga": ["yoga"],
    "pilates": ["pilates"],
    "dance": ["dance", "cardio dance", "tanzen", "gesellschaftstanz"],
    "cooldown": ["cooldown", "cool down", "cool-down", "abkühlen"],
}

REGISTRY_SCHEMA = "metric string, unit string, agg string, category string, tier string, least double, most double"
SAMPLES = "time timestamp, metric string, source string, unit string, qty double, vmin double, vavg double, vmax double, n int"


def registry_rows() -> list[tuple]:
    number = lambda x: float(x) if x else None
    return [(*f[:5], number(f[5]), number(f[6])) for f in (line.split("|") for line in REGISTRY.strip().splitlines())]


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(registry_rows(), REGISTRY_SCHEMA)


def conversions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONVERSIONS, "from_unit string, to_unit string, factor double")


def groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GROUPS, "canonical_type string, display_group string, sort int")


def workout_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, t) for t, names in NAMES.items() for n in names], "key string, canonical_type string")

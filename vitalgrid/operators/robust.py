"""Robust z scores: against a trailing window of observed rows, and against the whole series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.functions.arrays import let, median

SCALE = 0.6745


def robust_z(series: DataFrame, window: int = 28) -> DataFrame:
    """(series, day, value, z) of observed rows: against median and MAD of the ``window`` rows before; null where fewer, or where MAD is 0."""
    w = Window.partitionBy("series").orderBy("day").rowsBetween(-window, -1)
    df = series.filter("value is not null").withColumn("_w", F.array_sort(F.collect_list("value").over(w)))
    stats = let(F.col("_w"), lambda a: let(median(a), lambda m: F.struct(m.alias("m"), median(F.array_sort(F.transform(a, lambda x: F.abs(x - m)))).alias("d"))))
    df = df.withColumn("_s", F.when(F.size("_w") == window, stats))
    return df.withColumn("z", F.when(F.col("_s.d") > 0, F.lit(SCALE) * (F.col("value") - F.col("_s.m")) / F.col("_s.d"))).drop("_w", "_s")


def global_z(series: DataFrame) -> DataFrame:
    """(series, day, value, global_z) against each series' whole history."""
    seen = series.filter("value is not null")
    middle = seen.groupBy("series").agg(F.percentile("value", 0.5).alias("_m"))
    away = seen.join(middle, "series")
    spread = away.groupBy("series").agg(F.percentile(F.abs(F.col("value") - F.col("_m")), 0.5).alias("_d"))
    return away.join(spread, "series").withColumn("global_z", F.when(F.col("_d") > 0, F.lit(SCALE) * (F.col("value") - F.col("_m")) / F.col("_d"))).drop("_m", "_d")


def anomalies(series: DataFrame, window: int = 28, threshold: float = 3.5, recent_days: int | None = None, min_global: float | None = None) -> DataFrame:
    """Rows whose z exceeds ``threshold`` either way; optionally of the last days (inclusive) and far out globally too."""
    z = robust_z(series, window).filter(F.abs("z") > threshold)
    out = z.join(global_z(series).select("series", "day", "global_z"), ["series", "day"])
    if recent_days is not None:
        last = series.filter("value is not null").groupBy("series").agg(F.max("day").alias("_last"))
        out = out.join(last, "series").filter(F.col("day") >= F.date_sub("_last", recent_days)).drop("_last")
    return out if min_global is None else out.filter(F.abs("global_z") >= min_global)


def scored_pairs(series: DataFrame, rest: str, variability: str, window: int = 28) -> DataFrame:
    """(day, rest_z, variability_z) of the days on which both series have a score."""
    scored = robust_z(series.filter(F.col("series").isin(rest, variability)), window)
    pick = lambda name, out: scored.filter(F.col("series") == name).select("day", F.col("z").alias(out))
    return pick(rest, "rest_z").join(pick(variability, "variability_z"), "day").dropna()


def alarming(both: DataFrame, z: float = 1.5) -> DataFrame:
    return both.filter((F.col("rest_z") >= z) & (F.col("variability_z") <= -z)).withColumn("severity", (F.col("rest_z") - F.col("variability_z")) / 2.0)


def recovery_pairs(series: DataFrame, rest: str, variability: str, window: int = 28, z: float = 1.5) -> DataFrame:
    """Days on which resting rate is high and variability low at once."""
    return alarming(scored_pairs(series, rest, variability, window), z)

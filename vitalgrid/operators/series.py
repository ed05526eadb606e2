"""All analysis series in one long frame (series, day, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.functions.text import slug
from vitalgrid.operators.daily import daily_series, gaps_as_null, gaps_as_zero

LOADS = {"trimp": ["trimp"], "energy": ["load"], "both": ["trimp", "load"]}
#: Series of all sessions together beside the loads, and the daily sums they come from.
TOTALS = {"duration": "duration_h", "count": "count", "intensity": "intensity"}


def core(samples: DataFrame, registry: DataFrame, zone: str) -> DataFrame:
    return daily_series(samples, registry.filter("tier = 'core'"), zone)


def sleep(frame: DataFrame) -> DataFrame:
    names = ["sleep_total_h", "sleep_deep_h", "sleep_rem_h", "sleep_efficiency"]
    stack = ", ".join(f"'{n}', {n}" for n in names)
    return frame.select("day", F.expr(f"stack({len(names)}, {stack}) as (series, value)")).filter("value is not null").select("series", "day", "value")


def workouts(daily: DataFrame, by_type: DataFrame, load_metric: str = "both", edwards: bool = True) -> DataFrame:
    """Series of all sessions (loads, duration, count, intensity) and the loads of each type, zero on rest days within the observed span;
    intensity keeps its gaps. Zone load, of which ``edwards`` decides, comes only where some day has any.
    """
    loads = {n: n for n in LOADS[load_metric] + (["edwards"] if edwards else [])}

    def unpivot(df: DataFrame, names: dict[str, str], suffix: list[str]) -> DataFrame:
        stack = ", ".join(f"'workout_{n}', cast({c} as double)" for n, c in names.items())
        out = df.select("day", *suffix, F.expr(f"stack({len(names)}, {stack}) as (series, value)")).filter("value is not null")
        return out.select(F.concat("series", *[F.concat(F.lit("_"), slug(F.col(s))) for s in suffix]).alias("series"), "day", "value")

    both = unpivot(daily, loads | TOTALS, []).unionByName(unpivot(by_type.filter("canonical_type is not null"), loads, ["canonical_type"]))
    used = both.groupBy("series").agg(F.max("value").alias("_m")).filter(~F.col("series").startswith("workout_edwards") | (F.col("_m") > 0)).select("series")
    both = both.join(used, "series", "left_semi")
    gap = F.col("series") == "workout_intensity"
    return gaps_as_zero(both.filter(~gap)).unionByName(gaps_as_null(both.filter(gap)))

"""Training impulse formulas as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    """Within low and high; null stays null (least and greatest alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def reserve(hr: Column, rest: Column, most: Column) -> Column:
    """Share of the heart-rate reserve, within 0 and 1; null where rest and most are equal."""
    return clamp(F.try_divide(hr - rest, most - rest), 0.0, 1.0)


def weight(r: Column, sex: str | None = None) -> Column:
    return F.lit(0.86) * F.exp(F.lit(1.67) * r) if sex == "female" else F.lit(0.64) * F.exp(F.lit(1.92) * r)


def banister(duration_s: Column, avg_hr: Column, rest: Column, most: Column, sex: str | None = None) -> Column:
    """Minutes times reserve times its exponential weight; 0 where an input is missing or unusable."""
    r = reserve(avg_hr, rest, most)
    usable = (duration_s > 0) & avg_hr.isNotNull() & rest.isNotNull() & (most > rest)
    return F.when(usable, duration_s / 60.0 * r * weight(r, sex)).otherwise(F.lit(0.0))


def zone_weight(bpm: Column, most: Column) -> Column:
    """0 to 5: how many of 50, 60, 70, 80 and 90 % of the maximum are reached."""
    share = F.when(most > 0, bpm / most).otherwise(F.lit(0.0))
    return sum(((share >= k).cast("int") for k in (0.5, 0.6, 0.7, 0.8, 0.9)), F.lit(0))

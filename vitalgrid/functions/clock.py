"""Instants, local days and dense daily grids. The session's zone is UTC; days are those of a named zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def utc(ts: Column) -> Column:
    """A zoneless timestamp read as UTC."""
    return ts.cast("timestamp")


def local_time(ts: Column, zone: str) -> Column:
    return F.from_utc_timestamp(ts, zone)


def local_day(ts: Column, zone: str) -> Column:
    return F.to_date(local_time(ts, zone))


def seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1e6


def parse_instant(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` with an offset as +hhmm or +hh:mm; anything else is null."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss Z")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss XXX")))


def dense(series: DataFrame, keys: list[str], day: str = "day", fill: dict[str, float] | None = None) -> DataFrame:
    """Every day between a series' first and last, values null (or ``fill``) where none was: one pass to find the span, one join on (keys, day)."""
    span = series.groupBy(*keys).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    grid = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias(day))
    out = grid.join(series, [*keys, day], "left")
    return out.fillna(fill) if fill else out

"""Local-day aggregates of samples and the explorer's queries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.functions.clock import dense, local_day


def daily_metrics(samples: DataFrame, zone: str) -> DataFrame:
    """One hash aggregation over all metrics at once: mean, extremes, sum and count by (local day, metric)."""
    return samples.groupBy(local_day(F.col("time"), zone).alias("day"), "metric").agg(
        F.avg(F.coalesce("vavg", "qty")).alias("avg"), F.min(F.coalesce("vmin", "qty")).alias("min"), F.max(F.coalesce("vmax", "qty")).alias("max"),
        F.sum("qty").alias("sum"), F.sum("n").alias("n"),
    )


def by_aggregate(agg: Column) -> Column:
    """The daily value that a metric's own aggregate names; null for any other name."""
    return F.when(agg == "sum", F.col("sum")).when(agg == "avg", F.col("avg")).when(agg == "min", F.col("min")).when(agg == "max", F.col("max"))


def daily_series(samples: DataFrame, registry: DataFrame, zone: str) -> DataFrame:
    """(series, day, value): each registered metric's daily value, observed days only. The registry is a dimension of a few dozen rows."""
    daily = daily_metrics(samples, zone).join(F.broadcast(registry.select("metric", "agg")), "metric")
    return daily.select(F.col("metric").alias("series"), "day", by_aggregate(F.col("agg")).alias("value")).filter("value is not null")


def gaps_as_null(series: DataFrame) -> DataFrame:
    return dense(series, ["series"])


def gaps_as_zero(series: DataFrame) -> DataFrame:
    return dense(series, ["series"], fill={"value": 0.0})


def moving_average(daily: DataFrame, rows: int = 7) -> DataFrame:
    """Mean of the last ``rows`` observed rows (not days) of each series."""
    w = Window.partitionBy("series").orderBy("day").rowsBetween(1 - rows, 0)
    return daily.withColumn("moving_avg", F.avg("value").over(w))


def categories(samples: DataFrame, registry: DataFrame) -> DataFrame:
    metrics = samples.select("metric").distinct()
    return metrics.join(registry.select("metric", "category"), "metric", "left").select(F.coalesce("category", F.lit("other")).alias("category")).distinct()


def latest(series: DataFrame) -> DataFrame:
    """Each series' newest value, 2 decimals."""
    return series.groupBy("series").agg(F.max("day").alias("day"), F.round(F.max_by("value", "day"), 2).alias("value"))


def trailing(series: DataFrame, days: int, how: str) -> DataFrame:
    """avg, min or max over (last day - days, last day] of each series."""
    last = series.groupBy("series").agg(F.max("day").alias("_last"))
    inside = series.join(last, "series").filter(F.col("day") > F.date_sub("_last", days))
    return inside.groupBy("series").agg(F.round(getattr(F, how)("value"), 2).alias("value"))


def newest(samples: DataFrame, k: int = 500) -> DataFrame:
    """The newest ``k`` samples: a top-k report."""
    return samples.orderBy(F.desc("time"), "metric", "source").limit(k)

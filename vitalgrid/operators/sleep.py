"""One row a night, sleep efficiency (three definitions, each of its own use), regularity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.functions.clock import local_time, seconds


def nightly(sessions: DataFrame) -> DataFrame:
    """The session of most sleep for each date, of equals the earliest."""
    w = Window.partitionBy("sleep_date").orderBy(F.desc_nulls_last("total_sleep_h"), F.asc_nulls_last("sleep_start"), F.asc("id"))
    return sessions.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def in_bed_view() -> Column:
    """The stored hours if not zero, else the time in bed, else the phases' sum if not zero."""
    phases = F.coalesce("asleep_h", F.lit(0.0)) + F.coalesce("awake_h", F.lit(0.0))
    return F.coalesce(F.nullif("in_bed_h", F.lit(0.0)), seconds(F.col("in_bed_end"), F.col("in_bed_start")) / 3600.0, F.nullif(phases, F.lit(0.0)))


def with_efficiency(nights: DataFrame) -> DataFrame:
    share = (F.col("total_sleep_h") / F.col("in_bed_h_calc") * 100).cast("decimal(18,6)")
    df = nights.withColumn("in_bed_h_calc", in_bed_view())
    return df.withColumn("efficiency_pct", F.when(F.col("total_sleep_h").isNotNull() & (F.col("in_bed_h_calc") > 0), F.round(share, 1).cast("double")))


def in_bed_frame() -> Column:
    """Time in bed first, the stored hours where there is none."""
    return F.coalesce(seconds(F.col("in_bed_end"), F.col("in_bed_start")) / 3600.0, F.col("in_bed_h"))


def frame(nights: DataFrame, zone: str) -> DataFrame:
    """(day, sleep_total_h, sleep_deep_h, sleep_rem_h, sleep_efficiency, bedtime): the sleep series; bedtime is a local hour, seconds ignored."""
    start = local_time(F.coalesce("in_bed_start", "sleep_start"), zone)
    df = nights.withColumns({"_bed": in_bed_frame(), "_hour": F.hour(start) + F.minute(start) / 60.0})
    g = df.groupBy(F.col("sleep_date").alias("day")).agg(
        F.max("total_sleep_h").alias("sleep_total_h"), F.max("deep_h").alias("sleep_deep_h"), F.max("rem_h").alias("sleep_rem_h"), F.max("_bed").alias("_bed"), F.min("_hour").alias("bedtime"),
    )
    return g.withColumn("sleep_efficiency", F.when(F.col("_bed") > 0, F.col("sleep_total_h") / F.col("_bed"))).drop("_bed")


def intervals(sessions: DataFrame) -> DataFrame:
    """(start, end, efficiency): stored hours if positive, else time in bed; within (0, 1], 1 if unknown."""
    end = F.coalesce("sleep_end", "in_bed_end")
    bed = F.when(F.col("in_bed_h") > 0, F.col("in_bed_h")).otherwise(seconds(F.col("in_bed_end"), F.col("in_bed_start")) / 3600.0)
    share = F.try_divide(F.col("total_sleep_h"), bed)
    return sessions.filter(end > F.col("sleep_start")).select(F.col("sleep_start").alias("start"), end.alias("end"), F.when((bed > 0) & (share > 0), F.least(share, F.lit(1.0))).otherwise(F.lit(1.0)).alias("efficiency"))


def bedtime_offset(hour: Column) -> Column:
    """Hours since 18:00, 0 to 24."""
    return F.pmod(hour - 18.0, F.lit(24.0))


def regularity(series: DataFrame, window: int = 28) -> DataFrame:
    """Sample deviation over the last ``window`` observed values of each (series, day, value), where there are that many."""
    w = Window.partitionBy("series").orderBy(F.desc("day"))
    last = series.filter("value is not null").withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= window)
    g = last.groupBy("series").agg(F.count("value").alias("n"), F.stddev_samp("value").alias("std_hours"), F.min("day").alias("window_start"), F.max("day").alias("window_end"))
    return g.filter(F.col("n") == window).drop("n")

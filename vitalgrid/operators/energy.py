"""The clamped energy reserve: rates from stress and sleep, an integrator between 0 and 100, daily summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid import config as C
from vitalgrid.functions import scan
from vitalgrid.functions.clock import local_day, seconds
from vitalgrid.functions.impulse import clamp
from vitalgrid.functions.tables import kept
from vitalgrid.operators.stress import dwell, first_match, inside, subject_of, within


def auto_neutral(buckets: DataFrame, sleep: DataFrame) -> DataFrame:
    """One row (neutral): the 40th percentile of awake measured stress over the 60 days before the newest bucket, within 5 and 50; 25 from under 1440 rows."""
    key = subject_of(buckets, sleep)
    last = buckets.groupBy(*key).agg(F.max("ts").alias("_last"))
    awake = inside(buckets.filter("stress is not null"), sleep, "_asleep").filter("not _asleep")
    awake = last.join(awake, key, "left") if key else F.broadcast(last).crossJoin(awake)
    g = awake.filter(F.col("ts").isNull() | (F.col("ts") >= F.col("_last") - F.expr(f"interval {C.NEUTRAL_DAYS} days"))).groupBy(*key).agg(F.count("stress").alias("n"), F.percentile("stress", C.NEUTRAL_PCT).alias("p"))
    return g.select(*key, F.when(F.col("n") >= C.NEUTRAL_ROWS, clamp(F.bround("p", 1), C.NEUTRAL_LOW, C.NEUTRAL_HIGH)).otherwise(F.lit(C.NEUTRAL_DEFAULT)).alias("neutral"))


def rates(buckets: DataFrame, sleep: DataFrame, neutral: Column, e: C.Energy) -> DataFrame:
    """``buckets`` with ``rate`` (points a minute) and ``delta`` (over the dwell, which here runs across days). Sleep goes before activity."""
    df = first_match(dwell(buckets), sleep, "efficiency", "_eff")
    stress = F.col("stress").cast("double")
    quality = F.when(F.col("_eff") > 0, F.least("_eff", F.lit(1.0))).otherwise(F.lit(1.0))
    up = F.lit(e.charge) * F.coalesce(F.try_divide(neutral - stress, neutral), F.lit(0.0))
    down = F.lit(-e.drain) * F.coalesce(F.try_divide(stress - neutral, 100.0 - neutral), F.lit(1.0))
    rate = (
        F.when(F.col("_eff").isNotNull(), F.lit(e.sleep) * quality).when(F.col("state") == "active", F.lit(-e.active))
        .when((F.col("state") == "unmeasurable") | stress.isNull(), F.lit(0.0)).when(stress > neutral, down).otherwise(up)
    )
    return df.withColumn("rate", rate).withColumn("delta", F.col("rate") * F.col("dwell")).drop("_eff")


_TRIPLE = "struct<d:double,lo:double,hi:double>"


def _then(f: Column, g: Column) -> Column:
    """The clamped step f, then g, as one: x -> min(hi, max(lo, x + d))."""
    within_g = lambda x: F.least(g["hi"], F.greatest(g["lo"], x + g["d"]))
    return F.struct((f["d"] + g["d"]).alias("d"), within_g(f["lo"]).alias("lo"), within_g(f["hi"]).alias("hi"))


def _applied(f: Column, x: Column) -> Column:
    return F.when(f.isNull(), x).otherwise(F.least(f["hi"], F.greatest(f["lo"], x + f["d"])))


def integrate(steps: DataFrame, seed: float = 50.0, slot: int = 64) -> DataFrame:
    """(ts, level) after each bucket, clamped to 0..100, per ``subject`` if there is one; a null delta changes nothing.

    A step x -> min(hi, max(lo, x + d)) composes with the next into one of its kind. So each ``slot`` rows of a day are summed up to a triple,
    the triples are folded along a day's slots and along the days, and levels within a slot follow from its start. All of it is arrays of
    bounded length in the JVM: a slot's rows, a day's slots, a subject's days.
    """
    key = subject_of(steps)
    rows = steps.select(*key, "ts", F.coalesce("delta", F.lit(0.0)).alias("delta"), F.to_date("ts").alias("_d"))
    rows = rows.withColumn("_slot", F.floor((F.row_number().over(within(key, "_d").orderBy("ts")) - 1) / slot))
    held = kept(rows.groupBy(*key, "_d", "_slot").agg(F.array_sort(F.collect_list(F.struct("ts", "delta"))).alias("_steps")), "slots")  # read for days, starts and levels
    one = lambda x: F.struct(x["delta"].alias("d"), F.lit(0.0).alias("lo"), F.lit(100.0).alias("hi"))
    none, full = F.lit(None).cast(_TRIPLE), scan.either(_then)
    whole = lambda items, of: F.aggregate(items, none, lambda acc, x: full(acc, of(x)))
    days = held.select(*key, "_d", F.struct("_slot", whole(F.col("_steps"), one).alias("t")).alias("_s")).groupBy(*key, "_d").agg(F.array_sort(F.collect_list("_s")).alias("_slots"))
    days = days.withColumn("_all", whole(F.col("_slots"), lambda x: x["t"]))
    before = scan.carried(days.select(*key, "_d", "_all"), key, "_d", "_all", _TRIPLE, _then)
    starts = scan.fold(F.col("_slots"), none, f"struct<slot:bigint,t:{_TRIPLE}>", lambda acc, x: full(acc, x["t"]), lambda acc, x: F.struct(x["_slot"].alias("slot"), acc.alias("t")))
    starts = days.join(before, [*key, "_d"]).select(*key, "_d", _applied(F.col("carry"), F.lit(float(seed))).alias("_day_start"), F.explode(starts).alias("_s"))
    starts = starts.select(*key, "_d", F.col("_s.slot").alias("_slot"), _applied(F.col("_s.t"), F.col("_day_start")).alias("_start"))
    after = lambda x, item: F.least(F.lit(100.0), F.greatest(F.lit(0.0), x + item["delta"]))
    levels = scan.fold(F.col("_steps"), F.col("_start"), "struct<ts:timestamp,level:double>", after, lambda x, item: F.struct(item["ts"].alias("ts"), after(x, item).alias("level")))
    return held.join(starts, [*key, "_d", "_slot"]).select(*key, F.explode(levels).alias("_l")).select(*key, "_l.ts", "_l.level")


def wake_ends(sleep: DataFrame, zone: str) -> DataFrame:
    """(day, wake): end of the longest interval that ends on each local day, of equals the earliest."""
    df = sleep.withColumns({"day": local_day(F.col("end"), zone), "_s": seconds(F.col("end"), F.col("start"))})
    return df.groupBy(*subject_of(sleep), "day").agg(F.max_by("end", F.struct("_s", -F.unix_micros("start"))).alias("wake"))


def daily(levels: DataFrame, wakes: DataFrame, zone: str) -> DataFrame:
    """(day, high_level, low_level, charged, drained, wake_level): extremes, sums of rises and falls within the day, level at or just before waking."""
    key = subject_of(levels, wakes)
    df = levels.withColumn("day", local_day(F.col("ts"), zone))
    df = df.withColumn("_diff", F.col("level") - F.lag("level").over(within(key, "day").orderBy("ts"))).join(wakes, [*key, "day"], "left")
    before = F.when(F.col("ts") <= F.col("wake"), F.col("ts"))
    return df.groupBy(*key, "day").agg(
        F.max("level").alias("high_level"), F.min("level").alias("low_level"), F.sum(F.greatest(F.coalesce("_diff", F.lit(0.0)), F.lit(0.0))).alias("charged"),
        F.sum(F.greatest(-F.coalesce("_diff", F.lit(0.0)), F.lit(0.0))).alias("drained"), F.max_by(F.when(before.isNotNull(), F.col("level")), before).alias("wake_level"),
    )


def informative_days(buckets: DataFrame, zone: str, least: int = 60) -> DataFrame:
    """Days with at least ``least`` buckets (not minutes) that say something."""
    return buckets.filter("state <> 'unmeasurable'").groupBy(*subject_of(buckets), local_day(F.col("ts"), zone).alias("day")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).drop("n")

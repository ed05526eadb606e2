"""The stress timeline: interval joins, bucket scores, dwell, daily summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from vitalgrid import config as C
from vitalgrid.functions import scan
from vitalgrid.functions.clock import local_day, seconds
from vitalgrid.functions.impulse import clamp


def subject_of(*frames: DataFrame) -> list[str]:
    """["subject"] where all ``frames`` have that column, [] where none has. One with and one without would mix people up, so that raises."""
    have = {"subject" in f.columns for f in frames}
    if len(have) > 1:
        raise ValueError("either all tables have a subject column or none")
    return ["subject"] if have == {True} else []


def beside(rows: DataFrame, one: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` beside their subject's row of ``one``; without subjects that is a single row, so it is sent to all tasks."""
    return rows.join(one, key) if key else rows.crossJoin(F.broadcast(one))


def within(key: list[str], *more: str) -> WindowSpec:
    """A window a subject, and by what more is named. Without either there is one partition: see functions.scan for running values."""
    return Window.partitionBy(*key, *more)


def merged(intervals: DataFrame) -> DataFrame:
    """Overlapping or touching [start, end) made one, by gaps and islands within each ``subject`` if there is one.

    Islands are made within the day of their start first; a day's islands then go on from what earlier days reach.
    """
    key = subject_of(intervals)
    df = intervals.filter(F.col("end") > F.col("start")).select(*key, "start", "end", F.to_date("start").alias("_day"))
    w = within(key, "_day").orderBy("start", "end")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    fresh = lambda reach: reach.isNull() | (F.col("start") > reach)
    in_one = df.withColumn("_reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    in_day = in_one.withColumn("_i", F.max(F.when(fresh(F.col("_reach")), F.col("start"))).over(upto))
    days = in_day.groupBy(*key, "_day", F.col("_i").alias("start")).agg(F.max("end").alias("end"))
    # Along the days: how far intervals reach, and the start of the island that reaches there.
    ends = days.groupBy(*key, "_day").agg(F.max("start").alias("start"), F.max("end").alias("end"))
    listed = ends.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_day", "start", "end"))).alias("_all"))
    state = "struct<reach:timestamp,open:timestamp>"
    onward = lambda s, x: F.struct(F.greatest(s["reach"], x["end"]).alias("reach"), F.when(s["reach"].isNull() | (x["start"] > s["reach"]), x["start"]).otherwise(s["open"]).alias("open"))
    none = F.struct(F.lit(None).cast("timestamp").alias("reach"), F.lit(None).cast("timestamp").alias("open"))
    carry = scan.fold(F.col("_all"), none, f"struct<_day:date,s:{state}>", onward, lambda s, x: F.struct(x["_day"].alias("_day"), s.alias("s")))
    over = listed.select(*key, F.explode(carry).alias("_c")).select(*key, "_c._day", F.col("_c.s.reach").alias("_reach"), F.col("_c.s.open").alias("_open"))
    named = days.join(over, [*key, "_day"], "left").withColumn("_i", F.coalesce(F.max(F.when(fresh(F.col("_reach")), F.col("start"))).over(upto), "_open"))
    return named.groupBy(*key, "_i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_i")


def _by_day(intervals: DataFrame) -> DataFrame:
    """A row for each UTC day an interval touches."""
    last = F.to_date(F.col("end") - F.expr("interval 1 microsecond"))
    return intervals.withColumn("_day", F.explode(F.sequence(F.to_date("start"), last)))


def inside(points: DataFrame, intervals: DataFrame, out: str = "inside", ts: str = "ts") -> DataFrame:
    """``points`` (unique by subject and ts) with a boolean: in any [start, end). An equi join on the day with a residual test, not a nested loop."""
    key = subject_of(points, intervals)
    iv = _by_day(merged(intervals.select(*key, "start", "end")))
    return _met(points, iv, key, ts).select(*points.columns, F.col("_start").isNotNull().alias(out))  # merged intervals hold a point once at most


def _met(points: DataFrame, by_day: DataFrame, key: list[str], ts: str) -> DataFrame:
    """``points`` beside the intervals that hold them, or nulls; an interval's columns start with an underscore."""
    iv = by_day.select(*[F.col(c).alias(c if c == "_day" else f"_{c}") for c in by_day.columns])
    on = (F.to_date(points[ts]) == iv["_day"]) & (points[ts] >= iv["_start"]) & (points[ts] < iv["_end"])
    for k in key:
        on &= points[k] == iv[f"_{k}"]
    return points.join(iv, on, "left")


def _first_wins(intervals: DataFrame, value: str) -> DataFrame:
    """Disjoint (start, end, value): each interval's stretch after the ends of all that come before it by start and end, if any is left.

    At every instant that is the earliest-starting interval there. Ends are carried within the day of the start first, then along the days.
    """
    key = subject_of(intervals)
    df = intervals.filter(F.col("end") > F.col("start")).dropna(subset=key).select(*key, "start", "end", F.col(value).alias("_value"), F.to_date("start").alias("_day"))
    earlier = within(key, "_day").orderBy("start", "end", "_value").rowsBetween(Window.unboundedPreceding, -1)
    reach = scan.carried(df.groupBy(*key, "_day").agg(F.max("end").alias("_end")), key, "_day", "_end", "timestamp", F.greatest)
    df = df.withColumn("_own", F.max("end").over(earlier)).join(reach, [*key, "_day"], "left")
    return df.select(*key, F.greatest("start", "_own", "carry").alias("start"), "end", "_value").filter(F.col("end") > F.col("start"))


def first_match(points: DataFrame, intervals: DataFrame, value: str, out: str, ts: str = "ts") -> DataFrame:
    """``points`` with ``value`` of the earliest-starting interval that holds them (of equals the earliest-ending, then the smallest value).

    Points and disjoint stretches are sorted along each day and the last stretch is carried on, so however many intervals overlap, rows do not multiply.
    """
    key = subject_of(points, intervals)
    parts = _by_day(_first_wins(intervals, value))
    marks = parts.select(*key, "_day", F.greatest("start", F.col("_day").cast("timestamp")).alias("_at"), F.lit(0).alias("_k"), F.struct("end", "_value").alias("_part"))
    rows = points.select(*key, F.to_date(ts).alias("_day"), F.col(ts).alias("_at"), F.lit(1).alias("_k"), F.struct(*points.columns).alias("_point"))
    last = F.last("_part", ignorenulls=True).over(within(key, "_day").orderBy("_at", "_k").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = rows.unionByName(marks, allowMissingColumns=True).withColumn("_part", last).filter("_k = 1")
    return met.select("_point.*", F.when(F.col("_at") < F.col("_part.end"), F.col("_part._value")).alias(out))


def intraday_hr(samples: DataFrame) -> DataFrame:
    """(ts, bpm): mean over sources at each instant."""
    return samples.filter("metric = 'heart_rate'").groupBy(*subject_of(samples), F.col("time").alias("ts")).agg(F.avg(F.coalesce("vavg", "qty")).alias("bpm"))


def intraday_steps(samples: DataFrame) -> DataFrame:
    """(ts, steps): largest over sources at each instant, so that two devices do not count twice."""
    return samples.filter("metric = 'step_count'").groupBy(*subject_of(samples), F.col("time").alias("ts")).agg(F.max("qty").alias("steps"))


def stored(buckets: DataFrame, start, end) -> DataFrame:
    """Stored buckets of [start, end), in order."""
    return buckets.filter((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end))).orderBy("ts")


def workout_intervals(workouts: DataFrame, start=None, until=None) -> DataFrame:
    """(start, end) of each session, the end from its length where there is none; with bounds, of sessions that meet [start, until)."""
    end = F.coalesce(F.col("end_time"), F.timestamp_micros(F.unix_micros("start_time") + (F.col("duration_s") * 1e6).cast("long")))
    found = workouts.select(*subject_of(workouts), F.col("start_time").alias("start"), end.alias("end")).dropna()
    return found if start is None else found.filter((F.col("end") >= F.lit(start)) & (F.col("start") < F.lit(until)))


def cadence_is_fine(steps: DataFrame, most_s: float = 120.0) -> DataFrame:
    """One row (a subject): whether steps come about by the minute (median gap; two rows at least)."""
    key = subject_of(steps)
    gaps = scan.neighbour(steps.select(*key, "ts"), key, "ts", "_last", ahead=False).select(*key, seconds(F.col("ts"), F.col("_last")).alias("gap"))
    return gaps.groupBy(*key).agg(F.percentile("gap", 0.5).alias("median_gap")).withColumn("fine", F.coalesce(F.col("median_gap") <= most_s, F.lit(False)))


def state(stress: Column, s: C.Stress) -> Column:
    return F.when(stress < s.low, "rest").when(stress < s.medium, "low").when(stress < s.high, "medium").otherwise("high")


def timeline(hr: DataFrame, rest: DataFrame, hrv_z: DataFrame, workouts: DataFrame, steps: DataFrame, zone: str, s: C.Stress, hr_max: float | Column, rest_default: float | Column) -> DataFrame:
    """(ts, day, stress, hr, state) of each heart-rate bucket: 0 to 100, null and ``active`` in workouts or above the step threshold,
    null and ``unmeasurable`` without a positive reserve; a threshold of 0 asks for no steps at all. The zone follows the unrounded score; the stored one is rounded half-even.
    ``hr_max`` and ``rest_default`` are numbers, or columns of ``hr``.
    """
    key = subject_of(hr, rest, hrv_z, workouts, steps)
    df = inside(hr, workouts, "_workout").join(steps, [*key, "ts"], "left").withColumn("day", local_day(F.col("ts"), zone))
    df = df.join(rest.select(*key, "day", "rest"), [*key, "day"], "left").join(hrv_z.select(*key, "day", "hrv_z"), [*key, "day"], "left")
    r = F.coalesce("rest", F.lit(rest_default))
    span = F.lit(s.reserve_full) * (F.lit(hr_max) - r)
    mod = clamp(1 - F.lit(s.hrv_weight) * F.coalesce("hrv_z", F.lit(0.0)), 1 - s.hrv_weight, 1 + s.hrv_weight)
    df = df.withColumn("_raw", F.when((F.lit(hr_max) > r) & F.col("bpm").isNotNull(), clamp(100 * clamp((F.col("bpm") - r) / F.nullif(span, F.lit(0.0)), 0.0, 1.0) * mod, 0.0, 100.0)))
    walking = F.coalesce(F.col("steps") >= s.steps_per_min, F.lit(False)) if s.steps_per_min > 0 else F.lit(False)
    active = F.col("_workout") | walking
    df = df.withColumn("state", F.when(active, "active").when(F.col("_raw").isNull(), "unmeasurable").otherwise(state(F.col("_raw"), s)))
    return df.select(*key, "ts", "day", F.when(active, F.lit(None)).otherwise(F.rint("_raw")).cast("int").alias("stress"), F.col("bpm").alias("hr"), "state")


def dwell(buckets: DataFrame, *keys: str) -> DataFrame:
    """``buckets`` with ``dwell`` (minutes to the next, 10 at most; 1 for the last) and ``excess`` (the rest of the gap), within ``keys`` and subject."""
    key = subject_of(buckets)
    if keys:
        df = buckets.withColumn("_next", F.lead("ts").over(within(key, *keys).orderBy("ts")))
    else:
        df = scan.neighbour(buckets, key, "ts", "_next", ahead=True)
    df = df.withColumn("_gap", seconds(F.col("_next"), F.col("ts")) / 60.0)
    return df.withColumns({"dwell": F.when(F.col("_gap").isNull(), F.lit(C.BUCKET_MIN)).otherwise(F.least("_gap", F.lit(C.GAP_CAP_MIN))), "excess": F.greatest(F.coalesce("_gap", F.lit(0.0)) - C.GAP_CAP_MIN, F.lit(0.0))}).drop("_gap", "_next")


def daily(buckets: DataFrame) -> DataFrame:
    """Minutes by state, dwell restarting each local day; excess counts as unmeasurable; the score is the dwell-weighted mean of rounded stress."""
    df = dwell(buckets, "day")
    minutes = lambda name: F.sum(F.when(F.col("state") == name, F.col("dwell")).otherwise(F.lit(0.0)))
    measured = F.sum(F.when(F.col("stress").isNotNull(), F.col("dwell")).otherwise(F.lit(0.0)))
    g = df.groupBy(*subject_of(buckets), "day").agg(
        *[minutes(x).alias(f"{x}_min") for x in ("rest", "low", "medium", "high", "active")], (minutes("unmeasurable") + F.sum("excess")).alias("unmeasurable_min"),
        measured.alias("measured_min"), F.try_divide(F.sum(F.col("stress") * F.col("dwell")), measured).alias("score"),
    )
    return g


def stored_daily(days: DataFrame, s: C.Stress) -> DataFrame:
    """As stored: measured long enough, score to one decimal, whole minutes."""
    keep = days.filter((F.col("measured_min") >= s.min_measured) & F.col("score").isNotNull())
    return keep.select(*subject_of(days), "day", F.bround("score", 1).alias("score"), *[F.rint(c).cast("int").alias(c) for c in days.columns if c.endswith("_min") and c != "measured_min"])


def recent(days: DataFrame, n: int) -> DataFrame:
    """The last n days before the newest stored day, both ends in."""
    key = subject_of(days)
    last = days.groupBy(*key).agg(F.max("day").alias("_last"))
    return beside(days, last, key).filter(F.col("day") >= F.date_sub("_last", n)).drop("_last")


def window_bounds(hr: DataFrame, zone: str, days: int | None) -> DataFrame:
    """One row (a subject) of (start, end, first_day): local midnight ``days`` - 1 days before the newest sample's day, to a second after it.
    Without ``days``, from the oldest sample on.
    """
    key = subject_of(hr)
    span = hr.groupBy(*key).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).filter("hi is not null")
    first = local_day(F.col("lo"), zone) if days is None else F.date_sub(local_day(F.col("hi"), zone), days - 1)
    start = F.col("lo") if days is None else F.to_utc_timestamp(first.cast("timestamp"), zone)
    return span.select(*key, start.alias("start"), (F.col("hi") + F.expr("interval 1 second")).alias("end"), first.alias("first_day"))

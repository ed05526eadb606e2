"""Lagged rank correlation with false-discovery control, and the ranking of its findings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Member sets of the domains.
AUTONOMIC = ["respiratory_rate", "heart_rate_variability", "cardio_recovery"]
HR_RATE = ["heart_rate", "resting_heart_rate", "walking_heart_rate_average"]
VITAL = ["vo2_max", "apple_sleeping_wrist_temperature", "weight_body_mass", "blood_oxygen_saturation", "body_temperature", "breathing_disturbances"]
VOLUME = ["step_count", "active_energy", "apple_exercise_time", "walking_running_distance", "flights_climbed", "apple_stand_time"]


def tail(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """Two-sided Student tail, by the continued fraction of the incomplete beta function (Lentz)."""
    from math import lgamma

    out = np.empty(len(t))
    for i, (ti, n) in enumerate(zip(t, dof)):
        a, b, x = n / 2.0, 0.5, n / (n + ti * ti)
        if not np.isfinite(ti):
            out[i] = 0.0
            continue
        flip = x > (a + 1) / (a + b + 2)
        if flip:
            a, b, x = b, a, 1 - x
        front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(max(x, 1e-300)) + b * np.log(max(1 - x, 1e-300))) / a
        c, d = 1.0, 1.0 / max(1 - (a + b) * x / (a + 1), 1e-300)
        f = d
        for m in range(1, 300):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1.0 / (1 + top * d or 1e-300)
                c = 1 + top / c or 1e-300
                f *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        value = front * f
        out[i] = 1 - value if flip else value
    return np.clip(out, 0.0, 1.0)


@F.pandas_udf(T.DoubleType())
def p_value(r: pd.Series, n: pd.Series) -> pd.Series:

    r, dof = r.to_numpy(float), n.to_numpy(float) - 2
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(np.abs(r) >= 1, np.inf, np.abs(r) * np.sqrt(dof / ((1 - r) * (1 + r))))
    return pd.Series(tail(t, dof))


def pairs_at_lags(names: DataFrame, max_lag: int, redundant: Column | None = None) -> DataFrame:
    """(a, b, lag): lag 0 once for each unordered pair, lags 1 to ``max_lag`` both ways. ``redundant`` (of columns a, b) drops pairs beforehand.

    Names of series are a bounded dimension (some dozens), joined with themselves on inequality.
    """
    n = F.broadcast(names.select(F.col("series").alias("b")))
    both = names.select(F.col("series").alias("a")).join(n, F.col("a") != F.col("b"))
    if redundant is not None:
        both = both.filter(~redundant)
    lagged = both.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(max_lag))))
    return lagged.filter((F.col("lag") > 0) | (F.col("a") < F.col("b")))


def average_rank(value: str, *keys: str) -> Column:
    """Rank from 1, equal values sharing their mean."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2.0


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1, equal values sharing their mean."""
    _, where, many = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(many) - (many - 1) / 2.0)[where]


def _pair(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray], lag: int, min_overlap: int, min_active: int | None):
    """(coefficient, days, first day, last day) of dense arrays (start, values), or None where there is too little to rank."""
    (s, x), (t, y) = a, b
    first, last = max(s, t - lag), min(s + len(x), t - lag + len(y))
    if last - first < min_overlap:
        return None
    x, y = x[first - s : last - s], y[first + lag - t : last + lag - t]
    both = np.flatnonzero(~(np.isnan(x) | np.isnan(y)))
    if len(both) < max(min_overlap, 1):
        return None
    x, y = x[both], y[both]
    if x.min() == x.max() or y.min() == y.max() or min_active is not None and min(np.count_nonzero(x), np.count_nonzero(y)) < min_active:
        return None
    p, q = average_ranks(x), average_ranks(y)
    p, q = p - p.mean(), q - q.mean()
    return float((p @ q) / np.sqrt((p @ p) * (q @ q))), len(both), first + int(both[0]), first + int(both[-1])


def spearman(series: DataFrame, pairs: DataFrame, min_overlap: int = 42, min_active: int | None = None, blocks: int = 8) -> DataFrame:
    """(a, b, lag, coef, n, window_start, window_end): rank correlation of a[t] and b[t + lag] over their common days.

    The rows of ``series`` (one a series and day; null and NaN are no value) are shuffled once, to an array a series. Series are dealt to
    ``blocks``, pairs to the meetings of two blocks, and each array is sent to the meetings of its block that have a pair: a pair and its
    lags cost no rows, only ranks of array slices, which depend on the overlap. Too short, constant and too inactive candidates go before.
    """
    def held(pdf: pd.DataFrame) -> dict[str, tuple[int, np.ndarray]]:
        out = {}
        for name, days, values in zip(pdf["name"], pdf["days"], pdf["values"]):
            days = np.asarray(days, np.int64)
            dense = np.full(days.max() - days.min() + 1, np.nan)
            dense[days - days.min()] = np.asarray(values, float)
            out[name] = int(days.min()), dense
        return out

    columns = ["a", "b", "lag", "coef", "n", "window_start", "window_end"]

    def meet(arrays: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        have, rows = held(arrays), []
        for a, b, lag in zip(asked["a"], asked["b"], asked["lag"]):
            found = _pair(have[a], have[b], int(lag), min_overlap, min_active) if a in have and b in have else None
            if found:
                rows.append((a, b, lag, *found))
        return pd.DataFrame(rows, columns=columns)

    block = lambda name: F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int")
    cell = lambda x, y: F.least(x, y) * blocks + F.greatest(x, y)
    asked = pairs.select("a", "b", F.col("lag").cast("int").alias("lag"), cell(block("a"), block("b")).alias("cell"))
    seen = series.filter(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    rows = F.array_sort(F.collect_list(F.struct(F.unix_date("day").alias("d"), F.col("value").cast("double").alias("v"))))
    arrays = seen.groupBy(F.col("series").alias("name")).agg(rows.alias("_r")).select("name", F.col("_r.d").alias("days"), F.col("_r.v").alias("values"))
    sent = arrays.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda other: cell(block("name"), other))))
    out = sent.groupBy("cell").cogroup(asked.groupBy("cell")).applyInPandas(meet, "a string, b string, lag int, coef double, n long, window_start int, window_end int")
    return out.withColumns({c: F.date_from_unix_date(c) for c in ("window_start", "window_end")})


def adjusted(candidates: DataFrame, p: str = "p_value", order: tuple[str, ...] = ("a", "b", "lag")) -> DataFrame:
    """``candidates`` with ``p_adj`` after Benjamini and Hochberg, over all of them.

    Equal p share the last of their ranks, so ranks are counts of rows up to a value. Rows are dealt to ranges between quantiles of p (even
    buckets) and to the quantiles themselves, null and NaN (odd buckets, of one value each, which ``order`` spreads over tasks). Counts before
    a bucket and the minimum after it come from a summary of a row a bucket.
    """
    spark = candidates.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(candidates.approxQuantile(p, [k / parts for k in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    splits = F.array(*map(F.lit, cuts)).cast("array<double>")
    below = F.size(F.filter(splits, lambda x: x < F.col(p)))
    bucket = F.when(F.col(p).isNull(), -1).when(F.isnan(p), 2 * len(cuts) + 1).otherwise(2 * below + F.array_contains(splits, F.col(p).cast("double")).cast("int"))
    tied = F.pmod(F.col("_bucket"), F.lit(2)) == 1
    df = candidates.withColumn("_bucket", bucket).withColumn("_deal", F.when(tied, F.pmod(F.xxhash64(*order), F.lit(parts))).otherwise(0))
    every = F.broadcast(spark.range(-1, 2 * len(cuts) + 2).select(F.col("id").cast("int").alias("_bucket")))
    ahead = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size")).join(every, "_bucket", "right").fillna(0, ["_size"])
    sizes = sizes.select("_bucket", "_size", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_before"), F.sum("_size").over(Window.partitionBy(F.lit(0))).alias("_m"))
    own = Window.partitionBy("_bucket", "_deal")
    upto = F.count(F.lit(1)).over(own.orderBy(p))
    ranked = df.withColumn("_upto", upto).join(F.broadcast(sizes), "_bucket")
    ranked = ranked.withColumn("_q", F.col(p) * F.col("_m") / (F.col("_before") + F.when(tied, F.col("_size")).otherwise(F.col("_upto"))))
    after = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(1, Window.unboundedFollowing)
    least = ranked.groupBy("_bucket").agg(F.min("_q").alias("_least")).join(every, "_bucket", "right").select("_bucket", F.min("_least").over(after).alias("_later"))
    out = ranked.withColumn("_here", F.min("_q").over(own.orderBy(F.desc(p)))).join(F.broadcast(least), "_bucket")
    return out.withColumn("p_adj", F.least(F.lit(1.0), "_here", "_later")).select(*candidates.columns, "p_adj")


def best_lag(candidates: DataFrame) -> DataFrame:
    """The strongest lag of each unordered pair, of equals the shortest, then the first leader by name."""
    w = Window.partitionBy(F.least("a", "b"), F.greatest("a", "b")).orderBy(F.desc(F.abs("coef")), "lag", "a")
    return candidates.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def is_workout_family(s: Column) -> Column:
    return s.rlike("^workout_(trimp|load|edwards|duration|count|intensity)(_|$)")


def is_volume(s: Column) -> Column:
    return is_workout_family(s) | s.isin(VOLUME)


def domain(s: Column) -> Column:
    return (
        F.when(s.startswith("sleep_"), "sleep").when(s.isin(AUTONOMIC), "autonomic").when(s.isin(HR_RATE), "hr_rate").when(s.isin(VITAL), "vital")
        .when((s == "physical_effort") | is_volume(s), "activity").when(s == "time_in_daylight", "env").otherwise("other")
    )


def tier(a: Column, b: Column) -> Column:
    """0 for expected pairs, 2 for pairs across two known domains, else 1."""
    mixed = lambda x, y: ((a == x) & (b == y)) | ((a == y) & (b == x))
    known = ["sleep", "autonomic", "hr_rate", "vital", "activity"]
    expected = ((a == b) & a.isin("sleep", "hr_rate", "activity")) | mixed("hr_rate", "activity") | mixed("env", "activity")
    return F.when(expected, 0).when(a.isin(known) & b.isin(known), 2).otherwise(1)


def priority(tier: Column, coef: Column, lag: Column) -> Column:
    return 10 * tier + F.abs(coef) + 0.05 * F.least(lag, F.lit(3))

"""Seasonal-trend decomposition by LOESS, and what is read from it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid import config as C
from vitalgrid.functions.clock import dense
from vitalgrid.operators.correlation import average_rank


def interpolated(series: DataFrame) -> DataFrame:
    """Interior gaps of each dense series filled linearly in days."""
    grid = dense(series, ["series"])
    w = Window.partitionBy("series").orderBy("day")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("value").isNotNull(), F.struct("day", "value"))
    df = grid.withColumns({"_p": F.last(known, True).over(back), "_n": F.first(known, True).over(ahead)})
    gap = F.datediff("_n.day", "_p.day")
    share = F.datediff("day", "_p.day") / gap
    return df.select("series", "day", F.coalesce("value", F.col("_p.value") + (F.col("_n.value") - F.col("_p.value")) * share).alias("value"), F.col("value").isNotNull().alias("observed"))


def loess(y: np.ndarray, width: int, weights: np.ndarray | None = None, at: np.ndarray | None = None) -> np.ndarray:
    """Local straight lines with tricube weights over the ``width`` nearest points."""
    n = len(y)
    at = np.arange(n, dtype=float) if at is None else at
    q = min(width, n)
    left = np.clip(np.floor(at - (q - 1) / 2).astype(int), 0, n - q)
    idx = left[:, None] + np.arange(q)
    dist = np.abs(idx - at[:, None])
    reach = dist.max(axis=1) * (max(width, n) / n if width > n else 1.0)
    k = np.clip(1 - (dist / np.maximum(reach, 1e-12)[:, None] / 1.0001) ** 3, 0, None) ** 3
    if weights is not None:
        k = k * weights[idx]
    total = k.sum(axis=1)
    k = np.where(total[:, None] > 1e-12, k, 1.0)
    k = k / k.sum(axis=1, keepdims=True)
    xm = (k * idx).sum(axis=1)
    ym = (k * y[idx]).sum(axis=1)
    dx = idx - xm[:, None]
    var = (k * dx**2).sum(axis=1)
    slope = np.where(var > 1e-9, (k * dx * y[idx]).sum(axis=1) / np.maximum(var, 1e-12), 0.0)
    return ym + slope * (at - xm)


def _odd(x: float) -> int:
    n = int(np.ceil(x))
    return n if n % 2 else n + 1


def _average(x: np.ndarray, n: int) -> np.ndarray:
    c = np.cumsum(np.concatenate([[0.0], x]))
    return (c[n:] - c[:-n]) / n


def stl(y: np.ndarray, period: int, seasonal: int = 7, robust: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(trend, seasonal) after Cleveland and others (1990): cycle-subseries smoothing, low-pass removal, trend smoothing, robustness weights."""
    n = len(y)
    trend_width = _odd(1.5 * period / (1 - 1.5 / seasonal))
    low_width = _odd(period + 1)
    trend, season, weights = np.zeros(n), np.zeros(n), None
    for _ in range(16 if robust else 1):
        for _ in range(2):
            detrended = y - trend
            cycle = np.zeros(n + 2 * period)
            for p in range(period):
                part = detrended[p::period]
                w = None if weights is None else weights[p::period]
                cycle[p::period] = loess(part, seasonal, w, np.arange(-1, len(part) + 1, dtype=float))
            low = loess(_average(_average(_average(cycle, period), period), 3), low_width)
            season = cycle[period : period + n] - low
            trend = loess(y - season, trend_width, weights)
        residual = np.abs(y - trend - season)
        h = 6 * np.median(residual)
        if not robust or h <= 0:
            break
        weights = np.clip(1 - np.clip(residual / h, 0, 1) ** 2, 0, None) ** 2
    return trend, season


def mstl(y: np.ndarray, periods: tuple[int, ...] = (C.WEEK, C.YEAR), windows: tuple[int, ...] = (11, 15), passes: int = 2):
    """(trend, {period: seasonal}) for several periods by turns."""
    seasons = {p: np.zeros(len(y)) for p in periods}
    trend = np.zeros(len(y))
    for _ in range(passes):
        for p, width in zip(periods, windows):
            others = sum(s for q, s in seasons.items() if q != p)
            trend, seasons[p] = stl(y - others, p, width)
    return trend, seasons


SCHEMA = "series string, day date, value double, trend double, resid double, seasonal_7 double, seasonal_365 double, status string"


def decompose(series: DataFrame) -> DataFrame:
    """Per series and day: trend, residual, seasonal parts. Two years and more get both periods, 15 days and more the weekly one, shorter ones none.

    A series is one subject's days, some thousands; a series that fails says so in ``status`` and stops no other.
    """
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day").reset_index(drop=True)
        out = pdf[["series", "day", "value"]].copy()
        for c in ("trend", "resid", "seasonal_7", "seasonal_365"):
            out[c] = np.nan
        y = pdf["value"].to_numpy(float)
        n = int(pdf["observed"].sum())
        try:
            if n < 2 * C.WEEK + 1:
                out["status"] = "too short"
                return out.head(1).replace({np.nan: None})
            if n >= 2 * C.YEAR:
                trend, s = mstl(y)
                out["seasonal_7"], out["seasonal_365"] = s[C.WEEK], s[C.YEAR]
            else:
                trend, out["seasonal_7"] = stl(y, C.WEEK, robust=True)
            out["trend"] = trend
            out["resid"] = y - trend - out["seasonal_7"] - out["seasonal_365"].fillna(0.0)
            out["status"] = "ok"
            return out[pdf["observed"]].replace({np.nan: None})
        except Exception as e:  # contained: reported in the row
            out["status"] = f"failed: {type(e).__name__}"
            return out.head(1).replace({np.nan: None})

    return interpolated(series).groupBy("series").applyInPandas(one, SCHEMA)


def residuals(parts: DataFrame) -> DataFrame:
    return parts.filter("status = 'ok'").select("series", "day", F.col("resid").alias("value"))


def detrended(parts: DataFrame) -> DataFrame:
    return parts.filter("status = 'ok'").select("series", "day", (F.col("value") - F.col("trend")).alias("value"))


def strength(part: str) -> Column:
    """max(0, 1 - var(R) / var(part + R)), population variances."""
    return F.greatest(F.lit(0.0), 1 - F.try_divide(F.var_pop("resid"), F.var_pop(F.col(part) + F.col("resid"))))


def slope(series: DataFrame, value: str = "value") -> DataFrame:
    """(series, slope_per_day) by least squares."""
    return series.groupBy("series").agg(F.regr_slope(F.col(value), F.unix_date("day").cast("double")).alias("slope_per_day"))


def monotonicity(series: DataFrame, value: str = "value") -> DataFrame:
    """(series, monotonicity): size of the rank correlation with time; null where constant."""
    df = series.select("series", F.unix_date("day").alias("t"), F.col(value).alias("v")).filter("v is not null").withColumns({"rt": average_rank("t", "series"), "rv": average_rank("v", "series")})
    g = df.groupBy("series").agg(F.corr("rt", "rv").alias("_c"), F.min("v").alias("_a"), F.max("v").alias("_b"))
    return g.select("series", F.when(F.col("_a") < F.col("_b"), F.abs("_c")).alias("monotonicity"))


def reproducibility(series: DataFrame, value: str = "value", shared: int = 6) -> DataFrame:
    """(series, reproducibility): mean rank correlation of the month profiles of pairs of years with at least ``shared`` months in common."""
    month = series.filter(F.col(value).isNotNull()).groupBy("series", F.year("day").alias("y"), F.month("day").alias("m")).agg(F.avg(value).alias("v"))
    other = month.select("series", F.col("y").alias("y2"), "m", F.col("v").alias("v2"))
    both = month.join(other, ["series", "m"]).filter("y < y2")
    key = ["series", "y", "y2"]
    ranked = both.withColumns({"ra": average_rank("v", *key), "rb": average_rank("v2", *key)})
    g = ranked.groupBy(*key).agg(F.corr("ra", "rb").alias("c"), F.count(F.lit(1)).alias("n"), F.min("v").alias("a0"), F.max("v").alias("a1"), F.min("v2").alias("b0"), F.max("v2").alias("b1"))
    return g.filter((F.col("n") >= shared) & (F.col("a0") < F.col("a1")) & (F.col("b0") < F.col("b1"))).groupBy("series").agg(F.avg("c").alias("reproducibility"))


def annual(parts: DataFrame) -> DataFrame:
    """(series, strength, amplitude, peak_month, trough_month, phase_confident) of the yearly part."""
    yearly = parts.filter("seasonal_365 is not null")
    months = yearly.groupBy("series", F.month("day").alias("m")).agg(F.avg("seasonal_365").alias("v"))
    g = months.groupBy("series").agg((F.max("v") - F.min("v")).alias("amplitude"), F.max_by("m", F.struct("v", -F.col("m"))).alias("peak_month"), F.min_by("m", F.struct("v", "m")).alias("trough_month"))
    gap = F.abs(F.col("peak_month") - F.col("trough_month"))
    s = yearly.groupBy("series").agg(strength("seasonal_365").alias("strength"))
    return g.join(s, "series").withColumn("phase_confident", F.least(gap, 12 - gap) >= 2)

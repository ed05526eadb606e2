"""Running values along time without one task for all of it.

Rows are scanned within their day, in windows keyed by day; each day leaves a summary, and the summaries of a subject (or of the whole
table, which then is one person's) are folded in one array. The calendar bounds that array: a row a day, whatever the number of readings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Merge = Callable[[Column, Column], Column]


def fold(items: Column, zero: Column, kind: str, step: Callable[[Column, Column], Column], show: Callable[[Column, Column], Column]) -> Column:
    """An array of ``show(state before, item)`` (of type ``kind``) along ``items``, the state starting from ``zero``."""
    start = F.struct(zero.alias("acc"), F.array().cast(f"array<{kind}>").alias("out"))
    go = lambda s, x: F.struct(step(s["acc"], x).alias("acc"), F.concat(s["out"], F.array(show(s["acc"], x))).alias("out"))
    return F.aggregate(items, start, go, lambda s: s["out"])


def either(merge: Merge) -> Merge:
    """``merge`` where both are there, else the one that is."""
    return lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(merge(a, b))


def carried(days: DataFrame, key: list[str], day: str, value: str, kind: str, merge: Merge, later: bool = False) -> DataFrame:
    """(key, day, carry) of one row a key and day: ``value`` merged over all earlier days (or ``later`` ones), null where none has any.

    ``merge(nearer to the start, next)`` is associative; ``kind`` is the type of ``value``.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(day).alias("day"), F.col(value).alias("v"))))
    listed = days.filter(F.col(day).isNotNull()).groupBy(*key).agg((F.reverse(rows) if later else rows).alias("_all"))
    full = either(merge)
    out = fold(F.col("_all"), F.lit(None).cast(kind), f"struct<day:date,carry:{kind}>", lambda acc, x: full(acc, x["v"]), lambda acc, x: F.struct(x["day"].alias("day"), acc.alias("carry")))
    return listed.select(*key, F.explode(out).alias("_c")).select(*key, F.col("_c.day").alias(day), F.col("_c.carry").alias("carry"))


def neighbour(rows: DataFrame, key: list[str], ts: str, out: str, ahead: bool) -> DataFrame:
    """``rows`` with the instant of the next (``ahead``) or the last row of their key, over days. Reads ``rows`` twice: a table, not a long plan."""
    df = rows.withColumn("_day", F.to_date(ts))
    own = (F.lead if ahead else F.lag)(ts).over(Window.partitionBy(*key, "_day").orderBy(ts))
    ends = df.groupBy(*key, "_day").agg((F.min if ahead else F.max)(ts).alias("_end"))
    over = carried(ends, key, "_day", "_end", "timestamp", F.least if ahead else F.greatest, later=ahead)
    return df.withColumn("_own", own).join(over, [*key, "_day"], "left").withColumn(out, F.coalesce("_own", "carry")).select(*rows.columns, out)

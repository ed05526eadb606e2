"""Idempotent upserts as window picks over the union of stored and new rows, and window replacement on Parquet."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def last_wins(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row of largest ``seq`` for each key; null keys are equal."""
    return _pick(rows, keys, [F.desc(seq)])


def best_wins(rows: DataFrame, keys: list[str], score: str, seq: str) -> DataFrame:
    """The row of largest ``score`` for each key (null counts as -1), of equals the first."""
    return _pick(rows, keys, [F.coalesce(F.col(score), F.lit(-1.0)).desc(), F.asc(seq)])


def _both(stored: DataFrame, new: DataFrame, keys: list[str], tell: bool) -> DataFrame:
    both = stored.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    if not tell:
        return both
    return both.withColumn("_fresh", F.when(F.col("_age") == 1, F.min("_age").over(Window.partitionBy(*keys))))


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], seq: str, keep: list[str] | None = None, tell: bool = False) -> DataFrame:
    """Stored and new rows merged: new ones win, but a column of ``keep`` holds on to its last known value where the new one is null.

    ``tell`` adds ``_fresh``: 1 for a new row of a key that was not stored, 0 for one that took a stored row's place, null for stored rows.
    """
    both = _both(stored, new, keys, tell)
    w = Window.partitionBy(*keys).orderBy("_age", seq)
    for c in keep or []:
        both = both.withColumn(c, F.last(c, ignorenulls=True).over(w))
    return _pick(both, keys, [F.desc("_age"), F.desc(seq)]).drop("_age")


def upsert_best(stored: DataFrame, new: DataFrame, keys: list[str], score: str, seq: str, tell: bool = False) -> DataFrame:
    """As ``best_wins`` over both; stored rows come first, so an incoming row must be strictly fuller. ``tell`` as in ``upsert``."""
    both = _both(stored, new, keys, tell)
    return _pick(both, keys, [F.coalesce(F.col(score), F.lit(-1.0)).desc(), F.asc("_age"), F.asc(seq)]).drop("_age")


def new_keys(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of ``new`` that ``stored`` lacks (null-safe)."""
    a, b = new.select(*keys).distinct(), stored.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    return a.join(b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")


def collapse_sleep(rows: DataFrame) -> DataFrame:
    """One row for each (sleep_end, source): most sleep, then earliest start, then smallest id."""
    return _pick(rows, ["sleep_end", "source"], [F.desc_nulls_last("total_sleep_h"), F.asc_nulls_last("sleep_start"), F.asc("id")])


def unseen(bodies: DataFrame, archive: DataFrame, content: str = "content") -> DataFrame:
    """New bodies by SHA-256, repeats within the batch and those archived already left out."""
    hashed = bodies.withColumn("content_hash", F.sha2(F.col(content).cast("binary"), 256)).dropDuplicates(["content_hash"])
    return hashed.join(archive.select("content_hash"), "content_hash", "left_anti")


_MARK = "_replacing"


def _files(spark: SparkSession, path: str):
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def replace_window(table_path: str, window: DataFrame, day: str, first, last) -> None:
    """Puts ``window`` in place of the days ``first`` to ``last`` of a table partitioned by ``day``; days that vanished go too.

    The rows are staged beside the table first; then one marker, renamed into place, decides that they count. What follows (days
    taken out, staged days moved in) can be done again from the marker: ``complete`` finishes it after a crash, before the next read or
    replacement, and what was staged without a marker is deleted. One writer a table. So no mixture of old and new days outlives a crash.
    """
    spark = window.sparkSession
    complete(spark, table_path)
    root, fs = _files(spark, table_path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    staged = f"_staged-{uuid.uuid4().hex}"
    window.write.partitionBy(day).parquet(f"{table_path}/{staged}")
    mark = at(root, f"{_MARK}-{staged}")
    out = fs.create(mark)
    out.write(bytearray(json.dumps({"staged": staged, "day": day, "first": str(first), "last": str(last)}).encode()))
    out.close()
    fs.rename(mark, at(root, _MARK))
    complete(spark, table_path)


def complete(spark: SparkSession, table_path: str) -> None:
    """Finishes a replacement whose marker stands, and deletes what was staged without one. Does nothing to a whole or missing table."""
    root, fs = _files(spark, table_path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    names = lambda path: [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def text(path) -> str:
        source = fs.open(path)
        try:
            return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    mark = at(root, _MARK)
    if fs.exists(mark):
        told = json.loads(text(mark))
        staged = at(root, told["staged"])
        moved = [n for n in names(staged) if n.startswith(f"{told['day']}=")]
        done = at(root, f"{_MARK}-days")  # the staged days, kept so that a second try knows those moved already
        if not fs.exists(done):
            half = at(root, f"{_MARK}-half")
            out = fs.create(half)
            out.write(bytearray(json.dumps(moved).encode()))
            out.close()
            fs.rename(half, done)
        every = set(json.loads(text(done)))
        for name in names(root):
            value = name.partition("=")[2]
            if name.startswith(f"{told['day']}=") and told["first"] <= value <= told["last"] and name not in every:
                fs.delete(at(root, name), True)
        for name in moved:
            fs.delete(at(root, name), True)
            fs.rename(at(staged, name), at(root, name))
        fs.delete(done, False)
        fs.delete(mark, False)
    for name in names(root):
        if name.startswith(("_staged-", f"{_MARK}-")):
            fs.delete(at(root, name), True)

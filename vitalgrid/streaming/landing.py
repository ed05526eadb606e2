"""Exports from a landing folder, micro-batch by micro-batch, into idempotent tables; and the short intraday refresh."""

from __future__ import annotations

import functools

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vitalgrid.schema import registry
from vitalgrid.sources import merge, payload

#: Tables with their keys; late and repeated data is always accepted, so there is no watermark.
KEYS = {
    "metric_samples": ["metric", "time", "source"], "sleep_sessions": ["sleep_end", "source"], "workouts": ["hae_id"],
    "workout_hr_samples": ["workout_hae_id", "ts"], "workout_route_points": ["workout_hae_id", "ts"],
}


#: Tables of points in time, kept by the UTC day of this column; the same key always falls on the same day.
BY_DAY = {"metric_samples": "time", "workout_hr_samples": "ts", "workout_route_points": "ts"}
#: Tables that only grow.
APPENDED = {"raw_ingest"}


class Store:
    """Parquet tables under one folder as numbered versions; a version counts once it is whole, so readers see old or new, never half.

    A version of most tables is the table. A version of a table of ``BY_DAY`` holds the days its merge touched, and each day is read from the
    newest version that has it: a merge reads and writes the touched days only, however large the table. Of ``APPENDED`` tables all versions
    are read. What neither the newest nor the last state needs is deleted.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _inside(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def _versions(self, name: str) -> dict[int, list[str]]:
        """What is in each whole version, oldest first."""
        folders = [x for x in self._inside(f"{self.root}/{name}") if x[:1] == "v" and x[1:].isdigit()]
        found = {int(x[1:]): self._inside(f"{self.root}/{name}/{x}") for x in folders}
        return {v: found[v] for v in sorted(found) if "_SUCCESS" in found[v]}

    def _days(self, name: str, versions: dict[int, list[str]]) -> dict[str, str]:
        """The folder of each day in the newest version that has it."""
        return {d: f"{self.root}/{name}/v{v}/{d}" for v, inside in versions.items() for d in inside if d.startswith("utc_day=")}

    def _read_days(self, name: str, days: list[str]) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/empty", *days)

    def read(self, name: str) -> DataFrame | None:
        versions = self._versions(name)
        if not versions:
            return None
        if name in BY_DAY:
            return self._read_days(name, sorted(self._days(name, versions).values()))
        return self.spark.read.parquet(*[f"{self.root}/{name}/v{v}" for v in (versions if name in APPENDED else [max(versions)])])

    def replace(self, name: str, rows: DataFrame) -> None:
        """``rows`` as the table's next version; the state before the last is deleted."""
        versions = self._versions(name)
        last = max(versions, default=0)
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/v{last + 1}")
        for v in versions:
            if v < last:
                self._delete(f"{self.root}/{name}/v{v}")

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/v{max(self._versions(name), default=0) + 1}")

    def upsert(self, name: str, rows: DataFrame) -> dict[str, int]:
        """Merges ``rows`` into a table; how many of them are now ``stored``, and how many of those are of a ``new`` key, as the write saw them."""
        told = Observation()
        if name in BY_DAY:
            return self._upsert_days(name, rows, told)
        keys, old = KEYS[name], self.read(name)
        best = name == "sleep_sessions"
        new = merge.best_wins(rows, keys, "total_sleep_h", "seq") if best else merge.last_wins(rows, keys, "seq")
        if old is None:
            new = new.withColumn("_fresh", F.lit(1))
        else:
            new = merge.upsert_best(old, new, keys, "total_sleep_h", "seq", tell=True) if best else merge.upsert(old, new, keys, "seq", ["canonical_type"] if name == "workouts" else None, tell=True)
        self.replace(name, _watched(new, told))
        return _told(told)

    def _upsert_days(self, name: str, rows: DataFrame, told: Observation) -> dict[str, int]:
        path, keys, versions = f"{self.root}/{name}", KEYS[name], self._versions(name)
        day = F.date_from_unix_date(F.floor(F.unix_seconds(BY_DAY[name]) / 86400).cast("int"))
        new = merge.last_wins(rows, keys, "seq").persist()
        try:
            touched = [f"utc_day={r[0]}" for r in new.select(day).distinct().collect()]  # the days of one batch
            if not versions:
                new.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/empty")
            before, last = self._days(name, versions), max(versions, default=0)
            if touched or not versions:
                old = self._read_days(name, [before[d] for d in touched if d in before])
                both = _watched(merge.upsert(old, new, keys, "seq", tell=True), told).withColumn("utc_day", day)
                both.hint("rebalance", "utc_day").write.mode("overwrite").partitionBy("utc_day").parquet(f"{path}/v{last + 1}")
        finally:
            new.unpersist()
        kept = set(before.values()) | set(self._days(name, self._versions(name)).values())
        for v, inside in versions.items():
            folders = [f"{path}/v{v}/{d}" for d in inside if d.startswith("utc_day=")]
            gone = [f for f in folders if f not in kept]
            for f in [f"{path}/v{v}"] if len(gone) == len(folders) and v < last else gone:
                self._delete(f)
        return _told(told) if touched else {"stored": 0, "new": 0}


def _watched(merged: DataFrame, told: Observation) -> DataFrame:
    """``merged`` without its marks, which are counted as it is written."""
    return merged.observe(told, F.count("_fresh").alias("stored"), F.coalesce(F.sum("_fresh"), F.lit(0)).alias("new")).drop("_fresh")


def _told(told: Observation) -> dict[str, int]:
    try:
        return {k: int(v) for k, v in told.get.items()}
    except Py4JJavaError:  # the plan turned out to be empty and so did its counts
        return {"stored": 0, "new": 0}


#: What ``ingest`` counts in the parsed bodies.
QUALITY = ("implausible", "flagged", "skipped_sleep", "dropped_workouts", "flagged_energy")


def ingest(store: Store, bodies: DataFrame, type_map: dict[str, str] | None = None, dry_run: bool = False) -> dict[str, int]:
    """One batch of (path, body): hash, leave out seen bodies, archive, parse, upsert. Replaying a batch changes nothing: its bodies are archived.

    Returns counts: files, bad and new bodies; of points and sessions what was implausible, flagged, skipped or dropped; ``unknown_metrics``;
    and for each table ``<table>_stored`` and ``<table>_new``, which the writes themselves observe. Each body is parsed once, as the
    batch is held; all quality counts are one job over it. Paths of a batch are distinct. ``dry_run`` stores nothing and counts no tables.
    """
    spark = store.spark
    archive = store.read("raw_ingest")
    seen = archive if archive is not None else spark.createDataFrame([], "content_hash string")
    held = payload.status(bodies).withColumn("content_hash", F.sha2(F.col("body").cast("binary"), 256)).persist()
    chosen = held.filter("status = 'ok'").groupBy("content_hash").agg(F.min("path").alias("path")).join(seen.select("content_hash"), "content_hash", "left_anti").persist()
    try:
        files = held.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("status") == "bad").alias("bad"))
        counts = files.crossJoin(chosen.agg(F.count(F.lit(1)).alias("new"))).first().asDict()
        if not counts["new"]:
            return counts | dict.fromkeys(QUALITY, 0)
        fresh = held.join(chosen, ["content_hash", "path"]).select("content_hash", "path", "body", "v")
        tagged = fresh.select(F.col("path").alias("_path"), "body", "v")
        points = payload.metric_points(tagged)
        rows = payload.plausible(payload.normalise_units(payload.samples(points))).withColumn("seq", F.struct("_path", "pos"))
        sessions, dropped = payload.workouts(tagged, type_map=type_map)
        nights = payload.sleep_rows(points)
        n = F.count(F.lit(1))
        sleep_points = points.filter("name = 'sleep_analysis'")
        parts = [
            rows.agg(F.count_if("implausible").alias("implausible"), F.count_if("flagged").alias("flagged")), sleep_points.agg(n.alias("_points")), nights.agg(n.alias("_nights")),
            dropped.agg(n.alias("dropped_workouts")), sessions.agg(F.coalesce(F.sum("energy_flags"), F.lit(0)).alias("flagged_energy")),
        ]
        quality = functools.reduce(lambda a, b: a.crossJoin(b), parts).first().asDict()  # a row each
        quality["skipped_sleep"] = quality.pop("_points") - quality.pop("_nights")
        counts |= {k: quality[k] for k in QUALITY}
        if dry_run:
            return counts
        known = store.read("metric_registry")
        known = known if known is not None else registry(spark).select("metric", "unit", "agg", "category", "tier")
        stubs = payload.unregistered(rows.filter("not implausible").withColumn("pos", F.col("seq")), known)
        kept = rows.filter("not implausible").select("time", "metric", "source", "unit", "qty", "vmin", "vavg", "vmax", F.lit(None).cast("int").alias("n"), "seq")
        order = F.struct(F.col("_path"), F.col("pos").alias("pos"))
        tables = {
            "metric_samples": kept, "sleep_sessions": nights.withColumn("seq", F.struct("_path", "pos")).drop("_path", "pos"),
            "workouts": sessions.withColumn("seq", order).drop("w", "pos", "_path", "energy_flags"), "workout_hr_samples": payload.hr_samples(sessions), "workout_route_points": payload.route_points(sessions),
        }
        for name, part in tables.items():
            counts |= {f"{name}_{k}": v for k, v in store.upsert(name, part).items()}
        told = Observation()
        store.replace("metric_registry", _watched(known.withColumn("_fresh", F.lit(None).cast("int")).unionByName(stubs.withColumn("_fresh", F.lit(1))), told))
        counts["unknown_metrics"] = _told(told)["new"]
        store.append("raw_ingest", fresh.drop("v").withColumn("received_at", F.current_timestamp()))
        return counts
    finally:
        held.unpersist()
        chosen.unpersist()


def stream(spark: SparkSession, landing: str, store: Store, checkpoint: str, most_bytes: int = 32 << 20, type_map: dict[str, str] | None = None) -> StreamingQuery:
    """Everything in the landing folder once, by a file source and one merge a micro-batch; run it again for what came since."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.json").load(landing)
    bodies = files.filter(F.col("length") <= most_bytes).select("path", F.col("content").cast("string").alias("body"))
    return bodies.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: ingest(store, df, type_map)).start()


def rederive_hr(store: Store, dry_run: bool = False) -> int:
    """Heart-rate samples out of all archived bodies again, for fields that came to be read later; the number of samples stored, or with
    ``dry_run`` of those found, with nothing stored.
    """
    archive = store.read("raw_ingest")
    if archive is None:
        return 0
    found = payload.hr_samples(payload.workouts(archive.select(F.col("path").alias("_path"), "body"))[0])
    if dry_run:
        return merge.last_wins(found, KEYS["workout_hr_samples"], "seq").count()
    store.upsert("workout_hr_samples", found)
    return store.read("workout_hr_samples").count()

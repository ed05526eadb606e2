"""Operator commands over one store: python -m vitalgrid STORE COMMAND ..."""

from __future__ import annotations

import argparse
import datetime as dt
import itertools
import json

from pyspark.sql import DataFrame, SparkSession

from vitalgrid import config as C
from vitalgrid.operators import audit, daily, narrate, passes, sleep
from vitalgrid.sources import payload
from vitalgrid.streaming import landing


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vitalgrid")
    top.add_argument("store")
    top.add_argument("--config", help="JSON file of settings")
    sub = top.add_subparsers(dest="command", required=True)
    add = sub.add_parser("backfill", help="read exports from files and folders")
    add.add_argument("paths", nargs="+")
    add.add_argument("--dry-run", action="store_true")
    sub.add_parser("analyze", help="all series, passes and findings")
    sub.add_parser("audit", help="coverage, units, unmapped names, findings")
    add = sub.add_parser("check-workout-hr", help="array fields of the newest payloads' sessions")
    add.add_argument("--limit", type=int, default=20)
    sub.add_parser("rederive-workout-hr", help="heart-rate samples out of the archive again").add_argument("--dry-run", action="store_true")
    sub.add_parser("rederive", help="stress and energy timelines again").add_argument("--since-days", type=int)
    add = sub.add_parser("narrate", help="text of the current findings")
    add.add_argument("folder")
    add.add_argument("--lookback-days", type=int)
    add.add_argument("--language", choices=("en", "de"))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    c = C.from_dict(json.load(open(a.config, encoding="utf-8"))) if a.config else C.Config()
    store, derived = landing.Store(spark, a.store), f"{a.store}/derived"
    number, run = itertools.count(), dt.datetime.now(dt.timezone.utc)

    def written(df: DataFrame, name: str) -> DataFrame:
        path = f"{derived}/work/{name}-{next(number)}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    if a.command == "backfill":
        print(landing.ingest(store, payload.files(spark, a.paths), c.type_map, a.dry_run))
    elif a.command == "analyze":
        print(passes.analyze(store.read, c, derived, written, run) or "ok")
    elif a.command == "audit":
        stored = spark.read.parquet(f"{derived}/findings") if store._inside(f"{derived}/findings") else None
        samples = store.read("metric_samples")
        for name, part in audit.report(daily.daily_metrics(samples, c.zone), samples, store.read("metric_registry"), store.read("workouts"), stored, c.correlation.min_overlap, c.type_map).items():
            print(name)
            part.show(200, truncate=False)
    elif a.command == "check-workout-hr":
        audit.census(audit.newest(store.read("raw_ingest"), a.limit)).show(200, truncate=False)
    elif a.command == "rederive-workout-hr":
        print(landing.rederive_hr(store, a.dry_run))
    elif a.command == "rederive":
        read = lambda n: sleep.intervals(store.read("sleep_sessions")) if n == "sleep_intervals" else store.read(n)
        print(passes.refresh(read, c, derived, a.since_days))
    else:
        text = narrate.context(spark.read.parquet(f"{derived}/findings"), a.lookback_days or c.report.lookback_days, run.date(), a.language or c.report.language, c.report.max_correlations)
        print(narrate.write_report(text, a.folder, run.date()))


if __name__ == "__main__":
    main()

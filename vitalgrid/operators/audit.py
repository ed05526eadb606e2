"""Coverage, units, unmapped names, payload census."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.functions.text import with_canonical_type
from vitalgrid.sources import payload


def coverage(daily: DataFrame, registry: DataFrame, min_overlap: int = 42) -> DataFrame:
    """Days, span and density of every metric, core ones without any day too; ``readiness`` against the shortest overlap."""
    have = daily.groupBy("metric").agg(F.count(F.lit(1)).alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    df = have.join(F.broadcast(registry.select("metric", "tier")), "metric", "full").filter("days is not null or tier = 'core'").withColumn("days", F.coalesce("days", F.lit(0)).cast("long"))
    span = F.datediff("last_day", "first_day") + 1
    ready = F.when(F.col("days") == 0, "none").when(F.col("days") < min_overlap, "below").otherwise("ready")
    df = df.withColumns({"tier": F.coalesce("tier", F.lit("secondary")), "span_days": span, "density": F.round(F.col("days") / span, 4), "readiness": ready})
    return df.select("metric", "tier", "days", "first_day", "last_day", "span_days", "density", "readiness")


def by_rank(coverage: DataFrame) -> DataFrame:
    return coverage.orderBy(F.when(F.col("tier") == "core", 0).otherwise(1), "days", "metric")


def unit_anomalies(samples: DataFrame, registry: DataFrame) -> DataFrame:
    """Metrics stored in units other than their own."""
    seen = samples.select("metric", "unit").distinct().join(F.broadcast(registry.select("metric", F.col("unit").alias("canonical"))), "metric")
    g = seen.groupBy("metric", "canonical").agg(F.array_sort(F.collect_set("unit")).alias("units"))
    return g.filter(F.exists("units", lambda u: u != F.col("canonical")))


def unmapped(workouts: DataFrame, type_map: dict[str, str] | None = None) -> DataFrame:
    """(name, count) of names without a type."""
    return with_canonical_type(workouts.select("name").filter("name is not null"), type_map, out="_t").filter("_t is null").groupBy("name").count()


def by_kind(findings: DataFrame) -> DataFrame:
    return findings.groupBy("kind").agg(F.count(F.lit(1)).alias("count"))


def last_run(findings: DataFrame) -> DataFrame:
    """One row: the newest ``computed_at``."""
    return findings.agg(F.max("computed_at").alias("last_run"))


def newest(archive: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` payloads received last."""
    return archive.orderBy(F.desc("received_at"), "content_hash").limit(n)


def report(daily: DataFrame, samples: DataFrame, registry: DataFrame, workouts: DataFrame, findings: DataFrame | None, min_overlap: int = 42, type_map: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """All parts of an audit by name, lazily; without findings there are none of theirs."""
    parts = {"coverage": by_rank(coverage(daily, registry, min_overlap)), "units": unit_anomalies(samples, registry), "unmapped": unmapped(workouts, type_map)}
    return parts | ({} if findings is None else {"findings": by_kind(findings), "last_run": last_run(findings)})


def census(bodies: DataFrame, body: str = "body") -> DataFrame:
    """(field, sessions, least, most, median) of the array fields of the payloads' workouts; the median is cut to a whole number."""
    w = payload.parsed(bodies, body).select(F.explode(F.expr("try_variant_get(v, '$.data.workouts', 'array<variant>')")).alias("w"))
    f = w.select(F.explode(F.expr("try_variant_get(w, '$', 'map<string,variant>')")).alias("field", "x")).withColumn("n", F.size(F.expr("try_variant_get(x, '$', 'array<variant>')"))).filter("n >= 0")
    return f.groupBy("field").agg(F.count(F.lit(1)).alias("sessions"), F.min("n").alias("least"), F.max("n").alias("most"), F.floor(F.percentile("n", 0.5)).cast("int").alias("median"))

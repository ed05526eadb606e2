"""Adapters that shape the star-schema tables as samples, sessions, sleep and payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.functions.clock import utc
from vitalgrid.sources.merge import last_wins

ZONE = "Europe/Vienna"
# Aggregates of the adapted metrics.
AGGREGATES = [("click", "sum"), ("view", "avg"), ("purchase", "max"), ("signup", "min"), ("error", "avg"), *[(p, "sum") for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]]
HR_MAX = 190.0


class Tables:
    """Lazy adapters over one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def registry(self) -> DataFrame:
        rows = [(m, "count", a, "events" if m.isalpha() else "orders", "core", None, None) for m, a in AGGREGATES]
        return self.spark.createDataFrame(rows, "metric string, unit string, agg string, category string, tier string, least double, most double")

    def samples(self) -> DataFrame:
        e = self.raw("events")
        view, v = F.col("event_type") == "view", F.col("value")
        return e.select(
            utc(F.col("ts")).alias("time"), F.col("event_type").alias("metric"), F.col("user_id").cast("string").alias("source"), F.lit("count").alias("unit"),
            F.when(~view, v).alias("qty"), F.when(view, v * 0.9).alias("vmin"), F.when(view, v).alias("vavg"), F.when(view, v * 1.1).alias("vmax"), F.lit(None).cast("int").alias("n"),
        )

    def order_series(self) -> DataFrame:
        """(series, day, value): daily order totals by priority."""
        return self.raw("orders").groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("value"))

    def workouts(self) -> DataFrame:
        o = self.raw("orders")
        key = F.col("o_orderkey")
        start = F.timestamp_micros(F.unix_micros(utc(F.col("o_orderdate"))) + (key % 86400) * 1_000_000)
        hr = (90 + key % 90).cast("double")
        return o.select(
            key.alias("hae_id"), start.alias("start_time"), F.lit(None).cast("timestamp").alias("end_time"), F.col("o_orderpriority").alias("name"), (600 + F.col("o_custkey") % 3600).cast("double").alias("duration_s"),
            hr.alias("avg_hr"), (hr + 20).alias("max_hr"), (F.col("o_totalprice") / 1000).alias("active_energy_kcal"), F.when(key % 3 != 0, (key % 7).cast("double")).alias("intensity"),
            F.when(key % 4 != 0, (F.col("o_custkey") % 40).cast("double")).alias("distance_km"),
            F.element_at(F.array(*map(F.lit, ("running", "walking", "cycling", "strength", "yoga"))), (key % 5 + 1).cast("int")).alias("canonical_type"),
        )

    def hr(self) -> DataFrame:
        li = last_wins(self.raw("lineitem").withColumn("_s", F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")), ["l_orderkey", "l_linenumber"], "_s")
        w = self.workouts().select("hae_id", "start_time")
        ts = F.timestamp_micros(F.unix_micros("start_time") + F.col("l_linenumber").cast("long") * 60_000_000)
        return li.join(w, F.col("l_orderkey") == F.col("hae_id")).select(F.col("hae_id").alias("workout_hae_id"), ts.alias("ts"), (70 + 2 * F.col("l_quantity")).alias("bpm"))

    def resting(self) -> DataFrame:
        return self.raw("orders").groupBy(F.to_date("o_orderdate").alias("day")).agg((45 + F.count(F.lit(1)) % 20).cast("double").alias("value"))

    def hr_events(self) -> DataFrame:
        return self.raw("events").groupBy(utc(F.col("ts")).alias("ts")).agg(F.avg(50 + F.least("value", F.lit(140.0))).alias("bpm"))

    def steps_events(self) -> DataFrame:
        return self.raw("events").filter("event_type = 'click'").groupBy(utc(F.col("ts")).alias("ts")).agg(F.max("value").alias("steps"))

    def intervals(self) -> DataFrame:
        p = self.raw("events").filter("event_type = 'purchase'").select(utc(F.col("ts")).alias("start"))
        return p.withColumn("end", F.col("start") + F.expr("interval 600 seconds"))

    def sleep(self) -> DataFrame:
        e = self.raw("events").filter("event_type = 'signup'")
        end = F.date_trunc("hour", utc(F.col("ts")))
        total = F.col("value") / 10
        third = F.col("event_id") % 3 == 0
        return e.select(
            F.col("event_id").alias("id"), (utc(F.col("ts")) - F.expr("interval 8 hours")).alias("sleep_start"), end.alias("sleep_end"), (utc(F.col("ts")) - F.expr("interval 9 hours")).alias("in_bed_start"),
            F.when(F.col("event_id") % 2 == 0, end).alias("in_bed_end"), (F.col("user_id") % 3).cast("string").alias("source"), F.to_date("ts").alias("sleep_date"),
            total.alias("total_sleep_h"), (total / 5).alias("deep_h"), (total / 4).alias("rem_h"), (total * 0.9).alias("asleep_h"), (total * 0.1).alias("awake_h"), F.when(third, F.lit(0.0)).otherwise(total * 1.2).alias("in_bed_h"),
        )

    def sleep_intervals(self) -> DataFrame:
        """Short sleep-like intervals for the reserve: forty minutes from each signup, efficiency by user."""
        e = self.raw("events").filter("event_type = 'signup'").select(utc(F.col("ts")).alias("start"), ((F.col("user_id") % 4 + 1) / 4.0).alias("efficiency"))
        return e.withColumn("end", F.col("start") + F.expr("interval 40 minutes"))

    def payloads(self) -> DataFrame:
        """(seq, body): one JSON export for each user and day, both point shapes."""
        e = self.raw("events")
        date = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" +0200"))
        value = F.col("value").cast("string")
        point = F.when(F.col("event_type") == "view", F.concat(F.lit('{"date":"'), date, F.lit('","Min":null,"Avg":'), value, F.lit(',"Max":'), value, F.lit(',"source":"w"}'))).otherwise(F.concat(F.lit('{"date":"'), date, F.lit('","qty":'), value, F.lit("}")))
        m = F.concat(F.lit('{"name":"'), F.col("event_type"), F.lit('","units":"count","data":['), point, F.lit("]}"))
        g = e.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.array_join(F.array_sort(F.collect_list(m)), ",").alias("m"))
        return g.select(F.concat(F.col("user_id").cast("string"), F.lit(" "), F.col("d").cast("string")).alias("seq"), F.concat(F.lit('{"data":{"metrics":['), F.col("m"), F.lit('],"workouts":[]}}')).alias("body"))

    def vital_samples(self, subjects: int | None = None) -> DataFrame:
        """Metric rows of heart rate, resting rate, variability and steps out of the events; of several subjects if asked."""
        e, v = self.raw("events"), F.col("value")
        kinds = {"view": "heart_rate", "purchase": "resting_heart_rate", "signup": "heart_rate_variability", "click": "step_count"}
        metric = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("event_type")]
        who = [(F.col("user_id") % subjects).alias("subject")] if subjects else []
        qty = F.when(F.col("event_type") == "view", 50 + F.least(v, F.lit(140.0))).when(F.col("event_type") == "purchase", 45 + v % 20).otherwise(v)
        none = F.lit(None).cast("double")
        return e.select(*who, utc(F.col("ts")).alias("time"), metric.alias("metric"), F.lit("").alias("source"), F.lit("").alias("unit"), qty.alias("qty"), none.alias("vmin"), none.alias("vavg"), none.alias("vmax")).filter("metric is not null")

    def vital_workouts(self, subjects: int | None = None) -> DataFrame:
        """Ten minutes of exercise from each purchase."""
        p = self.raw("events").filter("event_type = 'purchase'")
        who = [(F.col("user_id") % subjects).alias("subject")] if subjects else []
        return p.select(*who, utc(F.col("ts")).alias("start_time"), F.lit(None).cast("timestamp").alias("end_time"), F.lit(600.0).alias("duration_s"))

    def vital_sleep(self, subjects: int | None = None) -> DataFrame:
        e = self.raw("events").filter("event_type = 'signup'")
        who = [(F.col("user_id") % subjects).alias("subject")] if subjects else []
        return e.select(*who, utc(F.col("ts")).alias("start"), (utc(F.col("ts")) + F.expr("interval 40 minutes")).alias("end"), ((F.col("user_id") % 4 + 1) / 4.0).alias("efficiency"))

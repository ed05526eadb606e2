"""The streamed reserve: two batches equal one, and both equal the batch operator."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalgrid.operators import energy
from vitalgrid.streaming import reserve


def run(spark, folder, checkpoint, out):
    stream = spark.readStream.schema("subject string, ts timestamp, rate double").parquet(str(folder))
    query = reserve.levels(stream).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination()


def test_two_batches_equal_one(spark, tmp_path):
    rng = np.random.default_rng(2)
    start, rows = dt.datetime(2024, 1, 1), []
    for who in ("a", "b"):
        minute = 0
        for _ in range(300):
            minute += int(rng.choice([1, 1, 1, 2, 30]))
            rows.append((who, start + dt.timedelta(minutes=minute), float(rng.normal(0, 4))))
    all_rows = spark.createDataFrame(rows, "subject string, ts timestamp, rate double")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", reserve.PROVIDER)
    try:
        cut = start + dt.timedelta(minutes=400)
        for name, parts in (("two", [all_rows.filter(F.col("ts") < F.lit(cut)), all_rows.filter(F.col("ts") >= F.lit(cut))]), ("one", [all_rows])):
            for part in parts:
                part.orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
                run(spark, tmp_path / name / "in", tmp_path / name / "ck", tmp_path / name / "out")
        late = spark.createDataFrame([("a", start, 90.0)], all_rows.schema)
        late.write.mode("append").parquet(str(tmp_path / "two" / "in"))
        run(spark, tmp_path / "two" / "in", tmp_path / "two" / "ck", tmp_path / "two" / "out")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = {name: {(r.subject, r.ts): r.level for r in spark.read.parquet(str(tmp_path / name / "out")).collect()} for name in ("one", "two")}
    assert got["two"] == got["one"] and len(got["one"]) == len(rows) - 2
    gap = (F.unix_micros(F.lead("ts").over(energy.within(["subject"]).orderBy("ts"))) - F.unix_micros("ts")) / 6e7
    batch = energy.integrate(all_rows.select("subject", "ts", (F.col("rate") * F.least(gap, F.lit(10.0))).alias("delta")))
    want = {(r.subject, r.ts): r.level for r in batch.collect()}
    assert all(got["one"][k] == pytest.approx(want[k], abs=1e-9) for k in got["one"])

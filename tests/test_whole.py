import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalgrid.operators import correlation
from vitalgrid.plans.catalog import QUERIES


def brute_adjusted(p):
    p = np.asarray(p)
    order = np.argsort(p, kind="stable")
    q = p[order] * len(p) / np.arange(1, len(p) + 1)
    out = np.empty(len(p))
    out[order] = np.minimum(1, np.minimum.accumulate(q[::-1])[::-1])
    return out


@pytest.mark.parametrize("kind", ["spread", "tied", "one", "small"])
def test_adjustment_equals_brute_force_over_buckets(spark, kind):
    rng = np.random.default_rng(5)
    p = {"spread": rng.random(500), "tied": rng.integers(0, 9, 500) / 8, "one": np.full(300, 0.25), "small": rng.random(400) ** 12}[kind]
    df = spark.createDataFrame([("a", str(i), 0, float(x)) for i, x in enumerate(p)], "a string, b string, lag int, p_value double").repartition(4)
    got = {int(r.b): r.p_adj for r in correlation.adjusted(df).collect()}
    assert len(got) == len(p) and [got[i] for i in range(len(p))] == pytest.approx(brute_adjusted(p).tolist())


def test_adjustment_of_no_rows_nulls_and_nan(spark):
    df = spark.createDataFrame([("a", str(i), 0, x) for i, x in enumerate([None, float("nan"), 0.01, 0.5])], "a string, b string, lag int, p_value double")
    assert [r.p_adj for r in correlation.adjusted(df).orderBy("b").collect()] == pytest.approx([0.02, 1.0, 0.02, 2 / 3])
    assert correlation.adjusted(df.limit(0)).count() == 0


def test_bh_fdr_adjusts_every_order(spark, tmp_path):
    keys = list(range(1, 400))
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.a: r.p_adj for r in QUERIES["bh_fdr"](spark, str(tmp_path)).collect()}
    assert sorted(got) == keys
    assert [got[k] for k in keys] == pytest.approx(brute_adjusted([(k * 7919 % 100003 + 1) / 100004 for k in keys]).tolist(), abs=1e-6)

import datetime as dt

import numpy as np
import pytest

from vitalgrid.operators import stress

START = dt.datetime(2004, 2, 27)


def minutes(m):
    return START + dt.timedelta(minutes=float(m))


def cases(subjects):
    rng = np.random.default_rng(11)
    iv = [(int(rng.integers(0, subjects)), int(a), int(a + rng.integers(-5, 400)), None if k % 9 == 0 else k / 4.0) for k, a in enumerate(rng.integers(0, 1440 * 6, 300))]
    iv += [(0, 100, 1440 * 3, 90.0), (0, 100, 200, 91.0), (0, 1440, 1440 * 2, 92.0), (0, 500, 500, 93.0), (0, 1440 * 9, 1440 * 12, 94.0)]
    at = sorted({*rng.integers(0, 1440 * 8, 900).tolist(), 0, 100, 200, 1440, 1440 * 3, 1440 * 9 + 1, 1440 * 11, 1440 * 12})
    return iv, [(k, m) for k in range(subjects) for m in at]


@pytest.mark.parametrize("subjects", [1, 3])
def test_first_match_equals_brute_force(spark, subjects):
    iv, points = cases(subjects)
    a = spark.createDataFrame([(k, minutes(m), str(m)) for k, m in points] + [(0, None, "none")], "subject int, ts timestamp, tag string")
    b = spark.createDataFrame([(k, minutes(x), minutes(y), v) for k, x, y, v in iv], "subject int, start timestamp, end timestamp, value double")
    if subjects == 1:
        a, b = a.drop("subject"), b.drop("subject")
    got = {(r["subject"] if subjects > 1 else 0, r["ts"]): r["out"] for r in stress.first_match(a, b, "value", "out").collect()}
    want = {(k, minutes(m)): min(((x, y, v) for j, x, y, v in iv if j == k and x <= m < y), key=lambda i: i[:2], default=(0, 0, None))[2] for k, m in points}
    assert got == want | {(0, None): None}
    assert stress.first_match(a, b.limit(0), "value", "out").filter("out is not null").count() == 0


def test_overlapping_intervals_do_not_multiply_rows(spark):
    """A thousand intervals hold every point: rows between the steps of the plan stay those of the two tables."""
    points = spark.range(2000).selectExpr("timestamp'2004-01-05 12:00:00' + make_dt_interval(0, 0, 0, id) as ts")
    naps = spark.range(1000).selectExpr("timestamp'2004-01-05 11:00:00' + make_dt_interval(0, 0, 0, id) as start", "timestamp'2004-01-05 18:00:00' + make_dt_interval(0, 0, 0, id) as end", "id / 1000.0D as efficiency")
    out = stress.first_match(points, naps, "efficiency", "eff")
    assert out.count() == 2000 and out.select("eff").distinct().collect() == [(0.0,)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert [x for x in plan.splitlines() if "Join" in x and ">=" in x] == []  # no join of instants with intervals

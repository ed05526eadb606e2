import json
from collections import Counter
from datetime import timedelta

import pyarrow.parquet as pq
import pytest

from vitalgrid import config as C
from vitalgrid.plans.catalog import QUERIES


def test_all_kinds_of_findings_with_no_bound_on_shape(spark):
    """Every series of two years has a seasonal finding, whatever the correlation of its years; settings still refuse such a bound."""
    found = QUERIES["findings_all"](spark, "/root/testdata/sf0.01").groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in found}["seasonality"] == 5
    with pytest.raises(ValueError):
        C.from_dict({"shape": {"reproducibility": -1.0}})


def test_every_stage_of_findings_all_shows(spark):
    """The status of all sports together, impulse before energy, and what each kind measured, the detrended correlations among it."""
    folder = "/root/testdata/sf0.01"
    found = [(r, json.loads(r.details)) for r in QUERIES["findings_all"](spark, folder).collect()]
    kind = lambda name: [(r, d) for r, d in found if r.kind == name]

    day_totals = Counter()
    for o in pq.read_table(f"{folder}/orders.parquet", columns=["o_orderdate", "o_totalprice"]).to_pylist():
        day = o["o_orderdate"]
        day_totals[day.date() if hasattr(day, "date") else day] += o["o_totalprice"]
    day, last, ctl, atl = min(day_totals), max(day_totals), 0.0, 0.0
    while day <= last:
        ctl, atl = ctl + (day_totals[day] - ctl) / C.CTL_TAU, atl + (day_totals[day] - atl) / C.ATL_TAU
        day += timedelta(days=1)
    [(status, d)] = kind("training_status")
    assert (status.metric_a, status.ref_date) == ("workout_trimp", last)
    assert d["ctl"] == pytest.approx(ctl, rel=1e-6) and d["atl"] == pytest.approx(atl, rel=1e-6) and d["tsb_pct"] == pytest.approx((ctl - atl) / ctl, abs=1e-4)

    loaded = [r.metric_a for r, _ in kind("training_load")]
    assert loaded and len(set(loaded)) == len(loaded) and all(x.startswith("workout_trimp") for x in loaded)
    apart = [d["detr_coef"] - d["raw_coef"] for _, d in kind("correlation")]  # of series with and without their trends: near, not equal
    assert any(apart) and max(map(abs, apart)) < 0.01
    assert len(kind("trend")) == 5 and all({"slope_per_day", "monotonicity"} <= set(d) for _, d in kind("trend"))
    assert all({"reproducibility", "amplitude"} <= set(d) for _, d in kind("seasonality"))
    assert all({"value", "z", "global_z"} <= set(d) for _, d in kind("anomaly"))

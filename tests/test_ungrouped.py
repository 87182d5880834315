"""Frames with no series key: one-row tables are broadcast, windows treat the table as one series."""

import numpy as np
from pyspark.sql import functions as F

from towerfill.operators import gaps, profile, quality, windows
from towerfill.timeline import Timeline


def test_ungrouped_histogram_and_iqr(spark, tower_df):
    one = tower_df.select("event_id", "datetime", "co2_flux", "air_temperature")
    h = profile.value_histogram(one, "co2_flux", 30)
    assert h.agg(F.sum("count")).first()[0] == one.filter("co2_flux IS NOT NULL").count()
    assert h.agg(F.max("bin")).first()[0] == 29
    out = quality.outlier_iqr(one, ["co2_flux", "air_temperature"], 1.5)
    vals = one.select("co2_flux").toPandas().co2_flux.dropna().to_numpy()
    q1, q3 = np.quantile(vals, [0.25, 0.75])
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    exp = int(((vals < lo) | (vals > hi)).sum())
    assert out.filter("co2_flux IS NULL").count() - one.filter("co2_flux IS NULL").count() == exp
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_single_series_split_equals_direct(spark, tower_df):
    one = tower_df.filter("series_id = 'click'").select("event_id", "datetime", "co2_flux")
    tl = Timeline(series=(), time="datetime", tiebreak=("event_id",))
    kw = dict(shift_cols=["co2_flux"], rolling_cols=["co2_flux"])
    a = windows.add_window_features(one, tl, **kw)
    b = windows.add_window_features(one, tl.with_(block_rows=170, ranges=8), **kw)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    r1 = gaps.gap_runs(one, tl.with_(ranges=1), "co2_flux")
    r2 = gaps.gap_runs(one, tl.with_(ranges=8), "co2_flux")
    assert sorted(map(tuple, r1.collect())) == sorted(map(tuple, r2.collect()))

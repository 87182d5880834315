"""Split-series windows must equal the plain per-series window."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from towerfill.fixtures import TOWER
from towerfill.functions.constants import ROLLING_WINDOWS, SHIFT_PERIODS
from towerfill.operators import gaps, windows
from towerfill.operators.sequence import INDEX, index_rows


def plain(df, shift=True, rolling=True, stats=("mean", "std"), direction="backward"):
    """The same features by one window per series."""
    w = Window.partitionBy("series_id").orderBy("datetime", "event_id")
    cols = windows.shift_exprs(w, ["co2_flux"], SHIFT_PERIODS, direction) if shift else []
    return df.select("*", *cols, *(windows.rolling_exprs(w, ["co2_flux"], ROLLING_WINDOWS, stats) if rolling else []))


def _rows(df, key="event_id"):
    return sorted(tuple(r) for r in df.orderBy(key).collect())


def test_index_is_dense_and_ordered(spark, tower_df):
    pdf = tower_df.select("event_id", "series_id", "datetime").toPandas()
    pdf = pdf.sort_values(["series_id", "datetime", "event_id"])
    pdf["g"] = pdf.groupby("series_id").cumcount()
    exp = dict(zip(pdf.event_id, pdf.g))
    tl = TOWER.with_(ranges=100)  # many tiny ranges
    x = index_rows(tower_df.select("event_id", "series_id", "datetime"), tl)
    assert {r.event_id: r[INDEX] for r in x.collect()} == exp


def test_range_numbering_with_one_repeated_stamp(spark, tower_df):
    """A third of the rows share one timestamp: range partitions stay balanced and exact."""
    from pyspark.sql import functions as F
    t = tower_df.select("event_id", "series_id", "datetime", "co2_flux").withColumn(
        "datetime", F.when(F.col("event_id") % 3 == 0, F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"))
                     .otherwise(F.col("datetime")))
    tl = TOWER.with_(ranges=20, block_rows=60)
    direct = plain(t)
    split = windows.add_window_features(t, tl, shift_cols=["co2_flux"], rolling_cols=["co2_flux"])
    assert _rows(direct) == _rows(split)
    g1 = gaps.gap_runs(t, tl, "co2_flux").collect()
    g2 = gaps.gap_runs(t, TOWER.with_(ranges=1), "co2_flux").collect()
    assert sorted(map(tuple, g1)) == sorted(map(tuple, g2))


def test_halo_blocks_equal_direct(spark, tower_df):
    base = tower_df.select("event_id", "series_id", "datetime", "co2_flux")
    kw = dict(shift_cols=["co2_flux"], rolling_cols=["co2_flux"], stats=["mean", "std", "min", "max"])
    direct = plain(base, stats=["mean", "std", "min", "max"])
    split = windows.add_window_features(base, TOWER.with_(block_rows=170, ranges=90), **kw)
    few = windows.add_window_features(base, TOWER.with_(block_rows=100), **kw)
    one = windows.add_window_features(base, TOWER, **kw)  # a series is one block
    a, b = _rows(direct), _rows(split)
    assert len(a) == base.count() and a == b
    assert _rows(few) == a and _rows(one) == a
    fwd_d = plain(base, rolling=False, direction="forward")
    fwd_s = windows.add_shift_features(base, TOWER.with_(block_rows=168, ranges=150), ["co2_flux"],
                                       direction="forward")
    assert _rows(fwd_d) == _rows(fwd_s)


def test_lead_then_lag_is_identity(spark, tower_df):
    base = tower_df.select("event_id", "series_id", "datetime", "co2_flux")
    x = windows.add_shift_features(base, TOWER.with_(block_rows=200), ["co2_flux"], periods=[3])
    y = windows.add_shift_features(x, TOWER.with_(block_rows=200), ["co2_flux_lag_3"], periods=[3],
                                   direction="forward")
    bad = y.filter(F.col("co2_flux_lag_3_lag_3").isNotNull()
                   & ~F.col("co2_flux_lag_3_lag_3").eqNullSafe(F.col("co2_flux")))
    assert bad.count() == 0


def test_gap_runs_cover_all_nulls(spark, tower_df):
    runs = gaps.gap_runs(tower_df, TOWER.with_(ranges=70), "co2_flux")
    direct = gaps.gap_runs(tower_df, TOWER, "co2_flux")
    assert sorted(map(tuple, runs.collect())) == sorted(map(tuple, direct.collect()))
    total = runs.agg(F.sum("length")).first()[0]
    assert total == tower_df.filter(F.col("co2_flux").isNull()).count()
    pdf = tower_df.select("series_id", "datetime", "event_id", "co2_flux").toPandas()
    pdf = pdf.sort_values(["series_id", "datetime", "event_id"])
    exp = []
    for sid, g in pdf.groupby("series_id"):
        isna = g.co2_flux.isna().tolist()
        i = 0
        while i < len(isna):
            if isna[i]:
                j = i
                while j < len(isna) and isna[j]:
                    j += 1
                exp.append((sid, i, j - i))
                i = j
            else:
                i += 1
    got = sorted((r.series_id, r.start_idx, r.length) for r in runs.collect())
    assert got == sorted(exp)

import math

from pyspark.sql import functions as F

from towerfill.functions import calendar, flux, meteo
from towerfill.operators import masking, profile
from towerfill.plans.features import feature_lists


def test_stability_bins_right_closed_and_infinities(spark):
    vals = [(-1e9,), (-200.0,), (-199.0,), (0.0,), (0.5,), (200.0,), (200.5,), (float("inf"),), (float("-inf"),),
            (None,)]
    df = spark.createDataFrame(vals, "L double")
    got = [tuple(r) for r in df.select(meteo.stability_class(F.col("L")), meteo.stability_index(F.col("L"))).collect()]
    assert got == [("very unstable", -3.0), ("very unstable", -3.0), ("unstable", -2.0), ("neutral unstable", -0.5),
                   ("neutral stable", 0.5), ("stable", 2.0), ("very stable", 3.0), ("very stable", 3.0),
                   (None, None), (None, None)]


def test_wind_sectors(spark):
    df = spark.createDataFrame([(0.0,), (22.5,), (22.6,), (45.0,), (359.9,), (360.0,), (-10.0,), (None,)], "d double")
    got = [r[0] for r in df.select(meteo.wind_sector(F.col("d"))).collect()]
    assert got == ["N", "N", "NNE", "NNE", "NNW", "N", "NNW", None]
    dummies = meteo.add_met_features(df.withColumnRenamed("d", "wind_dir"))
    assert [c for c in dummies.columns if c.startswith("wind_dir_") and c != "wind_dir_cat"] == \
        [f"wind_dir_{s}" for s in ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W",
                                   "WNW", "NW", "NNW"]]
    assert dummies.filter("wind_dir IS NULL").select(sum(F.col(c) for c in dummies.columns
                                                         if c.startswith("wind_dir_") and c != "wind_dir_cat")).first()[0] == 0


def test_calm_wind_and_zero_le(spark):
    df = spark.createDataFrame([(20.0, 50.0, 0.0, 400.0, 10.0, 0.0)], "t double, rh double, u double, r double, h double, le double")
    r = df.select(meteo.potential_et(F.col("t"), F.col("rh"), F.col("u"), F.col("r")).alias("pet"),
                  meteo.vp_slope(F.col("t")).alias("d"), flux.bowen(F.col("h"), F.col("le")).alias("b")).first()
    expected = r.d * 400.0 * 0.0864 / (r.d + 0.067) / 2.45e6 * 1000 * 86400  # u = 0: aerodynamic terms vanish
    assert math.isclose(r.pet, expected, rel_tol=1e-12) and r.b is None
    # diffuse ratio only where total > 0
    z = spark.createDataFrame([(5.0, 0.0), (5.0, 10.0)], "d double, t double")
    assert [x[0] for x in z.select(meteo.diff_ratio(F.col("d"), F.col("t"))).collect()] == [None, 0.5]


def test_season_and_iso_week(spark):
    df = spark.createDataFrame([("2023-12-31 23:30:00",), ("2024-03-01 06:00:00",), ("2024-12-30 12:00:00",)], "s string")
    df = calendar.add_time_features(df.select(F.col("s").cast("timestamp_ntz").alias("datetime")))
    got = [(r.season, r.season_0, r.weekofyear, r.weekday, r.is_weekend, r.is_night, r.is_morning, r.hour_decimal)
           for r in df.collect()]
    assert got == [(0, 1, 52, 6, 1, 1, 0, 23.5), (1, 0, 9, 4, 0, 0, 1, 6.0), (0, 1, 1, 0, 0, 0, 0, 12.0)]


def test_mask_zero_quota_and_absent_target(spark, tower_df):
    t = tower_df.select("event_id", "series_id", "co2_flux")
    m = masking.artificial_gaps(t, ["co2_flux", "not_there"], 0.0, "MCAR", row_key=["event_id"], by=["series_id"])
    assert m.agg(F.sum("masked_co2_flux")).first()[0] == 0 and "masked_not_there" not in m.columns
    m2 = masking.artificial_gaps(t, ["co2_flux"], 0.2, "MAR", "missing_col", row_key=["event_id"], by=["series_id"])
    m3 = masking.artificial_gaps(t, ["co2_flux"], 0.2, "MCAR", row_key=["event_id"], by=["series_id"])
    assert m2.exceptAll(m3).count() == 0  # MAR without its column falls back to MCAR


def test_plan_time_lists(spark, tower_df):
    from towerfill.fixtures import TOWER
    cols = tower_df.columns
    assert "co2_flux_qc" not in profile.plot_columns(tower_df) and "datetime" not in profile.plot_columns(tower_df)
    assert profile.flux_columns(tower_df) == ["co2_flux", "co2_flux_qc", "sensible_heat_flux", "latent_heat_flux"]
    assert "datetime" not in profile.target_candidates(tower_df) and len(profile.target_candidates(tower_df)) == len(cols) - 1
    base = profile.base_features(tower_df, ["co2_flux"], ["event_id", "series_id"])
    assert "co2_flux_qc" not in base and "co2_flux" not in base and "sensible_heat_flux" in base
    feats = calendar.add_time_features(tower_df)
    allf, timef = feature_lists(tower_df, feats, ["co2_flux"], TOWER)
    assert timef == [c for c in ["hour", "day", "month", "year", "dayofyear", "weekday", "is_weekend", "hour_sin",
                                 "hour_cos", "dayofyear_sin", "dayofyear_cos", "month_sin", "month_cos",
                                 "hour_decimal", "season", "season_0", "season_1", "season_2", "season_3",
                                 "is_morning", "is_afternoon", "is_evening", "is_night"]]
    assert allf == sorted(allf) and "month" in allf and "event_id" not in allf and "co2_flux" not in allf


def test_encoding_unseen_and_null_get_nan_code(spark):
    from towerfill.operators.encoding import apply_encoding, fit_encoding
    df = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    vocab = fit_encoding(df, ["c"])
    assert vocab == {"c": ["a", "b", "nan"]}
    new = spark.createDataFrame([("a",), ("zzz",), (None,), ("b",)], "c string")
    assert [r.c for r in apply_encoding(new, vocab).collect()] == [0, 2, 2, 1]


def test_ensure_datetime(spark):
    import pytest

    from towerfill.timeline import ensure_datetime
    df = spark.createDataFrame([("01.02.2024", "03:04:05", 1.0)], ["date", "time (UTC)", "v"])
    assert str(ensure_datetime(df).first().datetime) == "2024-02-01 03:04:05"
    has = spark.createDataFrame([(1.0,)], "v double").selectExpr("timestamp_ntz'2024-01-01 00:00:00' AS datetime", "v")
    assert ensure_datetime(has) is has
    with pytest.raises(ValueError):
        ensure_datetime(spark.createDataFrame([(1.0,)], "v double"))

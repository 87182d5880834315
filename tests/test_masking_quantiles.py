import numpy as np
import pytest
from pyspark.sql import functions as F

from towerfill.operators import masking, quality
from towerfill.operators.quantiles import exact_quantiles, quantile_table


PROBS = [0, 0.1, 0.25, 0.5, 0.9, 1]


@pytest.mark.parametrize("accuracy", [100, 200, 20_000])  # at 100 and 200 the brackets hold a part of each series
def test_quantiles_match_numpy(spark, tower_df, accuracy):
    pdf = tower_df.select("series_id", "co2_flux", "k").toPandas()
    got = quantile_table(tower_df, ["series_id"], {"a": F.col("co2_flux"), "b": F.col("k")}, PROBS, accuracy=accuracy).collect()
    assert len(got) == 2 * pdf.series_id.nunique()
    for r in got:
        vals = pdf.loc[pdf.series_id == r.series_id, {"a": "co2_flux", "b": "k"}[r.variable]].dropna().astype(float).to_numpy()
        assert np.allclose([r[f"q{i}"] for i in range(6)], np.quantile(vals, PROBS), rtol=0, atol=1e-9)


def test_quantiles_with_a_spike_and_ties(spark):
    """One value of 1e12 among 60,000: brackets are of equal depth, so it fills none of them."""
    df = spark.range(60_000).select(F.when(F.col("id") == 7, 1e12).otherwise((F.col("id") * 7919) % 1000 / 7.0).alias("v"))
    vals = df.toPandas()["v"].to_numpy()
    r = exact_quantiles(df, [], "v", PROBS, accuracy=2000).first()
    assert np.allclose([r[f"q{i}"] for i in range(6)], np.quantile(vals, PROBS), rtol=0, atol=1e-9)


def test_quantiles_without_values(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", None, None), ("c", float("nan"), None)], "g string, x double, y double")
    got = quantile_table(df, ["g"], {"x": F.col("x"), "y": F.col("y")}, [0.5]).collect()
    assert [(r.g, r.variable, r.q0) for r in got] == [("a", "x", 1.0)]


def test_mask_counts_and_determinism(spark, tower_df):
    t = tower_df.select("event_id", "series_id", "co2_flux", "sensible_heat_flux", "air_temperature")
    m = masking.artificial_gaps(t, ["co2_flux", "sensible_heat_flux"], 0.25, "MCAR", row_key=["event_id"],
                                by=["series_id"])
    for c in ("co2_flux", "sensible_heat_flux"):
        per = (t.groupBy("series_id").agg(F.count(c).alias("v"))
                .join(m.groupBy("series_id").agg(F.sum(f"masked_{c}").alias("m")), "series_id").collect())
        for r in per:
            assert r.m == int(r.v * 0.25)
    again = masking.artificial_gaps(t, ["co2_flux"], 0.25, "MCAR", row_key=["event_id"], by=["series_id"])
    a = {r.event_id for r in again.filter("masked_co2_flux = 1").collect()}
    b = {r.event_id for r in m.filter("masked_co2_flux = 1").collect()}
    assert a == b


def test_mask_ungrouped_tiny_bins_equals_sort(spark, tower_df):
    t = tower_df.select("event_id", "co2_flux").withColumn("dup", F.lit(1))
    x = t.withColumn("_key", F.when(F.col("co2_flux").isNotNull(), masking.seeded_uniform(7, ["dup"])))
    x = x.withColumn("_unit", F.col("_key")).withColumn("_n", F.lit(37).cast("long"))
    got = {r.event_id for r in masking.mark_smallest(x, [], ["event_id"], bins=2).filter("_sel").collect()}
    # all keys tie (same hash input), so the tiebreak decides: the 37 smallest event ids with a value
    exp = {r.event_id for r in t.filter("co2_flux IS NOT NULL").orderBy("event_id").limit(37).collect()}
    assert got == exp


def test_mnar_prefers_large_values(spark, tower_df):
    t = tower_df.select("event_id", "series_id", "co2_flux")
    m = masking.artificial_gaps(t, ["co2_flux"], 0.3, "MNAR", row_key=["event_id"], by=["series_id"])
    j = m.join(t.withColumnRenamed("co2_flux", "orig"), ["event_id", "series_id"])
    r = j.filter("orig IS NOT NULL").groupBy("masked_co2_flux").agg(F.avg(F.abs("orig")).alias("a")).collect()
    a = {x.masked_co2_flux: x.a for x in r}
    assert a[1] > a[0]


def test_modz_zero_mad_flags_all_but_median(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 5.0), (4, 9.0), (5, None)], "id int, x double")
    out = {r.id: r.x for r in quality.outlier_modz(df, ["x"], 3.5).collect()}
    assert out == {1: 5.0, 2: 5.0, 3: 5.0, 4: None, 5: None}

import math
import tempfile

from pyspark.sql import functions as F

from towerfill.fixtures import TOWER
from towerfill.operators import metrics, windows
from towerfill.plans import fill
from towerfill.plans.evaluate import evaluate, evaluation_metrics
from towerfill.plans.features import FeatureSpec, build_features, feature_lists
from towerfill.plans.modeling import ModelRegistry, train_models


def test_metrics_hand_values(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 5.0), (None, 1.0)], "y double, p double")
    r = metrics.regression_metrics(df, "y", "p").first()
    res = [-1.0, 0.0, -2.0]
    assert r.n == 3
    assert math.isclose(r.mae, 1.0)
    assert math.isclose(r.rmse, math.sqrt(sum(x * x for x in res) / 3))
    assert math.isclose(r.r2, 1 - 5.0 / 2.0)          # SST = 2
    assert math.isclose(r.slope, 1.5)                  # regress p on y: cov 1 / var 2/3
    rng = metrics.pair_range(df.na.drop(), "y", "p").first()
    assert (rng.min_val, rng.max_val) == (1.0, 5.0)


def test_one_exchange_for_all_window_features(spark, tower_df):
    base = tower_df.select("event_id", "series_id", "datetime", "co2_flux", "sensible_heat_flux")
    x = windows.add_window_features(base, TOWER, shift_cols=["co2_flux", "sensible_heat_flux"],
                                    rolling_cols=["co2_flux", "sensible_heat_flux"], stats=["mean", "std", "min", "max"])
    plan = x._jdf.queryExecution().executedPlan().toString()
    halo = [ln for ln in plan.splitlines() if "Exchange hashpartitioning(series_id" in ln and "_blk" in ln]
    assert len(halo) == 1, plan
    assert "SinglePartition" not in plan and "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def _small_models(spark, tower_df, model_type="rf"):
    spec = FeatureSpec(targets=["co2_flux"])
    feats, enc = build_features(tower_df, TOWER, spec)
    allf, timef = feature_lists(tower_df, feats, spec.targets, TOWER)
    params = {"numTrees": 5, "maxDepth": 4} if model_type == "rf" else {"maxIter": 5}
    return feats, train_models(feats, "co2_flux", allf, timef, spec, enc, model_type, params)


def test_fill_invariants_and_registry_roundtrip(spark, tower_df):
    feats, tm = _small_models(spark, tower_df)
    filled = fill.fill_gaps(tower_df, TOWER, tm, keep_original=True).cache()
    assert filled.filter(F.col("co2_flux").isNull()).count() == 0
    nulls = tower_df.filter(F.col("co2_flux").isNull()).count()
    assert filled.agg(F.sum("filled")).first()[0] == nulls
    routes = {r.route for r in filled.filter("filled = 1").select("route").distinct().collect()}
    assert routes <= {"ALL", "TIME"} and "TIME" in routes
    kept = filled.filter("filled = 0").filter(~F.col("co2_flux").eqNullSafe(F.col("co2_flux_original"))).count()
    assert kept == 0
    reg = ModelRegistry(spark, tempfile.mkdtemp(prefix="tf-reg-"))
    reg.save(tm)
    back = reg.load("rf", "co2_flux")
    assert back.all_features == tm.all_features and back.encoding == tm.encoding
    routed = fill.route(feats, "co2_flux", tm.all_features)
    a, b = (fill.predict(routed, m).select("event_id", "route", "_pred") for m in (tm, back))
    assert a.exceptAll(b).count() == 0
    assert a.filter("(route = 'observed') <> (_pred is null)").count() == 0
    assert reg.exists("rf", "co2_flux") and not reg.exists("gbt", "co2_flux")


def test_evaluate_report_and_gbt(spark, tower_df):
    _, tm = _small_models(spark, tower_df, "gbt")
    rep = evaluate(tower_df, TOWER, tm, "MNAR", 0.2, row_key=["event_id"]).cache()
    complete = tower_df.na.drop("any")
    exp = sum(int(r.n * 0.2) for r in complete.groupBy("series_id").agg(F.count("*").alias("n")).collect())
    assert rep.count() == exp
    assert rep.filter(F.col("original").isNull() | F.col("filled").isNull()).count() == 0
    assert {r.dependency_col for r in rep.select("dependency_col").distinct().collect()} == {"N/A"}
    m = evaluation_metrics(rep).first()
    assert m.n == exp and m.rmse >= m.mae


def test_leak_free_evaluation_refits_on_gapped_frame(spark, tower_df):
    _, tm = _small_models(spark, tower_df)
    rep = evaluate(tower_df, TOWER, tm, "MCAR", 0.2, row_key=["event_id"], leak_free=True).cache()
    complete = tower_df.na.drop("any")
    exp = sum(int(r.n * 0.2) for r in complete.groupBy("series_id").agg(F.count("*").alias("n")).collect())
    assert rep.count() == exp
    assert rep.filter(F.col("filled").isNull()).count() == 0
    # same cells hidden as the default order (same seed and row key)
    base = evaluate(tower_df, TOWER, tm, "MCAR", 0.2, row_key=["event_id"])
    assert {r.event_id for r in rep.collect()} == {r.event_id for r in base.collect()}


def test_leak_free_rolling_excludes_current_row(spark, tower_df):
    base = tower_df.select("event_id", "series_id", "datetime", "co2_flux")
    lf, _ = build_features(base, TOWER, FeatureSpec(targets=["co2_flux"], leak_free=True), {})
    d, _ = build_features(base, TOWER, FeatureSpec(targets=["co2_flux"]), {})
    # the leak-free 3-row mean at row i equals the standard 3-row mean ending at row i-1
    from pyspark.sql import Window
    w = Window.partitionBy("series_id").orderBy("datetime", "event_id")
    prev = d.select("event_id", F.lag("co2_flux_rolling_3_mean", 1).over(w).alias("p"))
    j = lf.select("event_id", "co2_flux_rolling_3_mean").join(prev, "event_id")
    assert j.filter(~F.col("co2_flux_rolling_3_mean").eqNullSafe(F.col("p"))).count() == 0


def test_sinks_names_and_roundtrip(spark, tower_df):
    import os

    from towerfill.plans.evaluate import write_report
    from towerfill.sources.text import read_csv
    _, tm = _small_models(spark, tower_df)
    d = tempfile.mkdtemp(prefix="tf-sink-")
    filled = fill.fill_gaps(tower_df, TOWER, tm)
    out = fill.write_export(filled, d, "co2_flux")
    assert out.endswith("gapfilled_co2_flux_clean") and os.path.isdir(out)
    back = read_csv(spark, out)
    assert back.columns == ["datetime", "co2_flux", "filled"] and back.count() == tower_df.count()
    assert back.filter(F.col("co2_flux").isNull()).count() == 0
    rep = evaluate(tower_df, TOWER, tm, "MAR", 0.1, "air_temperature", row_key=["event_id"])
    rp = write_report(rep, d, "co2_flux", "MAR")
    r = read_csv(spark, rp)
    assert rp.endswith("eval_report_co2_flux_MAR")
    assert {x.dependency_col for x in r.select("dependency_col").distinct().collect()} == {"air_temperature"}


def test_train_targets_and_latest(spark, tower_df):
    from towerfill.plans.modeling import train_targets
    spec = FeatureSpec(targets=["co2_flux", "sensible_heat_flux"])
    feats, enc = build_features(tower_df, TOWER, spec)
    sets = {t: feature_lists(tower_df, feats, spec.targets, TOWER) for t in spec.targets}
    models = train_targets(feats, spec.targets, sets, spec, enc, "rf", {"numTrees": 3, "maxDepth": 3})
    assert set(models) == {"co2_flux", "sensible_heat_flux"}
    # the ALL model of one target may use the other target's shift features (T22), never its own value
    assert "sensible_heat_flux_lag_3" in models["co2_flux"].all_features
    assert "co2_flux" not in models["co2_flux"].all_features
    filled = fill.fill_gaps(tower_df, TOWER, models["sensible_heat_flux"])
    assert filled.filter(F.col("sensible_heat_flux").isNull()).count() == 0
    reg = ModelRegistry(spark, tempfile.mkdtemp(prefix="tf-reg2-"))
    reg.save(models["co2_flux"])
    gbt = train_targets(feats, ["co2_flux"], sets, spec, enc, "gbt", {"maxIter": 2})["co2_flux"]
    reg.save(gbt)
    assert reg.latest("co2_flux").model_type == "gbt" and reg.load("rf", "co2_flux").model_type == "rf"


def test_a_save_cut_off_half_way_leaves_the_old_pair(spark, tower_df, monkeypatch):
    feats, tm = _small_models(spark, tower_df, "gbt")
    reg = ModelRegistry(spark, tempfile.mkdtemp(prefix="tf-reg-"))
    reg.save(tm)
    old = reg.commits("gbt", "co2_flux")
    newer = train_models(feats, "co2_flux", tm.all_features[:3], tm.time_features, tm.spec, tm.encoding, "gbt", {"maxIter": 2})
    for step in ("model_time", "metadata"):  # the save stops after ALL, or before the metadata is there
        broken = train_models.__globals__["TrainedModels"](**{**newer.__dict__})
        if step == "model_time":
            broken.model_time = type("Broken", (), {"save": lambda self, path: 1 / 0})()
        else:
            broken.metadata = lambda: 1 / 0
        try:
            reg.save(broken)
            raise AssertionError("the save went through")
        except ZeroDivisionError:
            pass
        assert reg.commits("gbt", "co2_flux") == old
        assert reg.load("gbt", "co2_flux").all_features == tm.all_features
    reg.save(newer)
    assert reg.load("gbt", "co2_flux").all_features == newer.all_features
    assert reg.load("gbt", "co2_flux", old[0]).all_features == tm.all_features
    assert reg.latest("co2_flux").all_features == newer.all_features


def test_tree_models_train_on_rows_that_lack_features(spark, tower_df):
    spec = FeatureSpec(targets=["co2_flux"])
    feats, enc = build_features(tower_df, TOWER, spec)
    allf, timef = feature_lists(tower_df, feats, spec.targets, TOWER)
    tm = train_models(feats, "co2_flux", allf, timef, spec, enc, "xgboost", {"trees": 2})
    reg = ModelRegistry(spark, tempfile.mkdtemp(prefix="tf-reg-"))
    reg.save(tm)
    back = reg.latest("co2_flux")
    assert back.accepts_missing and back.model_all.to_json() == tm.model_all.to_json()
    routed = fill.route(feats, "co2_flux", back.all_features, lacking="ALL").cache()
    lacking = routed.filter("route = 'ALL' AND co2_flux_lag_3 IS NULL").count()
    assert lacking > 0 and routed.filter("route = 'TIME'").count() == 0
    assert fill.fill_with_features(feats, back, lacking="ALL").filter("co2_flux IS NULL OR isnan(co2_flux)").count() == 0
    try:
        fill.fill_with_features(feats, _small_models(spark, tower_df, "gbt")[1], lacking="ALL")
        raise AssertionError("MLlib models can't score rows that lack features")
    except ValueError:
        pass

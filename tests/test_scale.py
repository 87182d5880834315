"""What keeps the tasks small: columns that travel, tables written before joins, parts by rows."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from towerfill.operators import masking, sequence
from towerfill.plans import modeling, trees
from towerfill.plans.features import FeatureSpec, build_features
from towerfill.sources import archive, text
from towerfill.timeline import Timeline

TL = Timeline(series=("s",), time="datetime", tiebreak=("id",))


@pytest.fixture
def written(monkeypatch):
    """(name, frame) of every table that the modules write."""
    out = []
    for module in (sequence, masking, modeling, trees, archive):
        def cut(df, name="stage", *rest, real=module.cut_lineage):
            out.append((name, df))
            return real(df, name, *rest)
        monkeypatch.setattr(module, "cut_lineage", cut)
    return out


def rows(spark, n=60):
    stamp = F.timestamp_add("HOUR", F.col("id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    value = F.when(F.col("id") % 7 > 0, F.col("id") * 1.5)
    return spark.range(n).select("id", (F.col("id") % 2).alias("s"), stamp.alias("datetime"), value.alias("x"),
                                 F.lit(200.0).alias("wind_dir"), F.lit(None).cast("double").alias("obukhov_length"))


def test_only_source_columns_travel_to_the_windows(spark, written):
    got, codes = build_features(rows(spark), TL, FeatureSpec(targets=["x"], periods=[1], windows=[3]))
    moved = dict(written)["range-numbered"].columns
    assert set(moved) - {"_p", "_pos"} == {"id", "s", "datetime", "x", "wind_dir", "obukhov_length"}
    assert got.columns[6:8] == ["hour", "day"] and got.columns.index("x_lag_1") > got.columns.index("is_night")
    r = got.filter("id = 25").first()
    assert (r.hour, r.x_lag_1, r.x_rolling_3_mean) == (1, 40.5, (34.5 + 37.5) / 2)
    assert (codes["wind_dir_cat"][r.wind_dir_cat], r.wind_dir_S, r.wind_dir_N) == ("S", 1, 0)
    assert codes["stability_class"][r.stability_class] == "nan"


def test_a_calendar_column_may_be_a_target(spark):
    got, _ = build_features(rows(spark), TL, FeatureSpec(targets=["hour"], periods=[1], windows=[3]))
    assert got.filter("id = 20").first().hour_lag_1 == 22


def test_a_long_series_is_many_blocks():
    assert TL.block_rows <= 1 << 16


def test_group_tables_are_written_before_they_are_joined(spark, written):
    got = masking.artificial_gaps(rows(spark), ["x"], 0.2, row_key=["id"], by=["s"])
    assert got.agg(F.sum("masked_x")).first()[0] == 10 and "thresholds" in dict(written)
    sequence.index_rows(rows(spark), TL)
    assert "offsets" in dict(written)


def test_models_train_on_parts_of_bounded_rows(spark, written, monkeypatch):
    seen = []

    class Fit:
        def fit(self, df):
            seen.append(df.rdd.getNumPartitions())

    monkeypatch.setattr(modeling, "_pipeline", lambda *a: Fit())
    monkeypatch.setattr(modeling, "ROWS_PER_TASK", 5)
    df = rows(spark).withColumn("a", F.col("id") * 1.0).coalesce(1)
    modeling.train_models(df, "x", ["a"], ["a"], FeatureSpec(targets=["x"]), {}, "rf")
    assert seen == [11, 11]  # 51 rows with a target
    monkeypatch.setattr(trees, "ROWS_PER_PART", 5)
    model = trees.fit_trees(df, "x", ["a"], {"trees": 1, "max_depth": 1})
    assert dict(written)["binned"].rdd.getNumPartitions() == 11 and model.trees[0]["feature"][0] == 0


def test_sums_do_not_depend_on_how_many_rows_are_added_at_once(spark, monkeypatch):
    df = rows(spark, 400).withColumn("a", (F.col("id") % 10) * 1.0).withColumn("x", F.col("a") * 2)
    whole = trees.fit_trees(df, "x", ["a"], {"trees": 2, "max_depth": 3})
    monkeypatch.setattr(trees, "ROWS_AT_ONCE", 7)
    assert trees.fit_trees(df, "x", ["a"], {"trees": 2, "max_depth": 3}).trees == whole.trees


def test_records_meet_their_file_s_header_without_a_pass_by_file(spark, tmp_path, written):
    for name, body in (("a", "made by,A\nat,B\n\nt,v,w\n1,2,3\n"), ("b", "t,v,w\n4,5,6\n\n7,,9\n")):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("t.csv", body)
    got = archive.read_table(spark, str(tmp_path), glob="*.zip")
    assert sorted((r.t, r.v, r.w) for r in got.collect()) == [(1, 2, 3), (4, 5, 6), (7, None, 9)]
    assert sorted(r._head for r in dict(written)["headers"].collect()) == [1, 4]
    with pytest.raises(ValueError, match="more fields"):
        archive.read_table(spark, str(tmp_path), glob="a.zip", skip_rows=1)


def test_a_member_s_records_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archive, "ROWS_PER_FILE", 10)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("t.csv", "t,v\n" + "".join(f"{i},x\n" for i in range(95)))
    lines = archive.read_lines(spark, str(tmp_path), "*.zip")
    assert len(lines.inputFiles()) == 10 and lines.count() == 96


def test_numbers_are_told_before_they_are_cast(spark):
    texts = ["1", "-1.5e3", " 7 ", "+.5", "5.", "1d", "2F", "NaN", "inf", "-Infinity", "1\t", "0x1p3", "a", "e5", "2024-01-01 00:00:00", "1 2", "", "-", "1,5", "i", "nan x"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    odd = df.filter("try_cast(trim(x) AS DOUBLE) IS NOT NULL").filter(~F.trim("x").rlike(text.MAYBE_NUMBER))
    assert odd.collect() == []
    assert df.filter(F.trim("x").rlike(text.MAYBE_NUMBER)).filter("x IN ('a', 'e5', '1 2', '2024-01-01 00:00:00')").count() == 0

import os
import tempfile
import zipfile

from pyspark.sql import functions as F

from towerfill.sources import archive, layouts, text
from towerfill.streaming import clean_stream


def test_clean_stream_matches_batch(spark, tower_df):
    d = tempfile.mkdtemp(prefix="tf-stream-")
    src = tower_df.select("event_id", "datetime", "co2_flux", "co2_flux_qc", "air_temperature", "relative_humidity",
                          "wind_dir", "obukhov_length")
    src.write.mode("overwrite").parquet(os.path.join(d, "in"))
    stream = spark.readStream.schema(src.schema).parquet(os.path.join(d, "in"))
    limits = {"co2_flux": ("co2_flux_qc", 1)}
    q = (clean_stream(stream, limits).writeStream.format("memory").queryName("tf_clean").outputMode("append")
         .option("checkpointLocation", os.path.join(d, "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = spark.table("tf_clean")
    exp = clean_stream(src, limits)
    assert got.count() == src.count()
    assert got.exceptAll(exp).count() == 0
    assert got.filter(F.col("co2_flux_qc") > 1).filter(F.col("co2_flux").isNotNull()).count() == 0


def test_layout_labels(spark):
    rows = [(202401010030, 202401010100, 1.5, -9999.0)]
    df = spark.createDataFrame(rows, "TIMESTAMP_START long, TIMESTAMP_END long, a double, b double")
    out, label = layouts.detect_layout(df)
    r = out.first()
    assert label == "FLUXNET" and str(r.datetime) == "2024-01-01 00:30:00" and r.b is None
    assert out.columns == ["datetime", "a", "b"]
    agg = spark.createDataFrame([("202401", 1.0, 2.0), ("20240105", 1.0, 2.0), ("2024010512", 1.0, 2.0),
                                 ("bad", 1.0, 2.0)], "TIMESTAMP string, NEE_VUT_REF double, x double")
    out, label = layouts.detect_layout(agg)
    got = [str(r.datetime) for r in out.collect()]
    assert label == "FLUXNET" and got == ["2024-01-01 00:00:00", "2024-01-05 00:00:00", "2024-01-05 12:00:00", "None"]
    none = spark.createDataFrame([(1, 2.0)], "a long, b double")
    assert layouts.detect_layout(none)[1] == "UNKNOWN (no time column)"
    ts = spark.createDataFrame([("2024-02-03 04:05:06", 1.0)], "datetime string, v double")
    out, label = layouts.detect_layout(ts)
    assert label == "GENERAL TIME SERIES" and str(out.first().datetime) == "2024-02-03 04:05:06"
    assert layouts.check_parse(spark.createDataFrame([("x", 1.0)], "datetime string, v double")
                               .transform(lambda d: layouts.detect_layout(d)[0]), "GENERAL TIME SERIES") \
        == "UNKNOWN (failed time parse)"


def test_csv_tokens_and_types(spark):
    d = tempfile.mkdtemp(prefix="tf-csv-")
    p = os.path.join(d, "a.csv")
    with open(p, "w") as fh:
        fh.write("t,n,x,s\n2024-01-01 00:00:00,1,1.5,a\n2024-01-01 00:30:00,NA,n/a,b\n2024-01-01 01:00:00,3,2,\n")
    df = text.read_csv(spark, p)
    assert dict(df.dtypes) == {"t": "string", "n": "bigint", "x": "double", "s": "string"}
    assert [tuple(r) for r in df.orderBy("t").collect()][1][1:3] == (None, None)


def test_zip_members_and_metadata_lines(spark):
    d = tempfile.mkdtemp(prefix="tf-zip-")
    with zipfile.ZipFile(os.path.join(d, "a.zip"), "w") as z:
        z.writestr("x/data.csv", "site A\nversion 2\ndatetime,v\n2024-01-01 00:00:00,1.0\n2024-01-01 00:30:00,-9999\n")
        z.writestr("notes.md", "ignore me")
    df = archive.read_table(spark, d, skip_rows="auto", glob="*.zip")
    out, label = layouts.detect_layout(df, sentinels=[-9999])
    rows = out.orderBy("datetime").collect()
    assert label == "GENERAL TIME SERIES" and [r.v for r in rows] == [1.0, None]
    plain = os.path.join(d, "plain")
    os.makedirs(plain)
    with open(os.path.join(plain, "p.txt"), "w") as fh:
        fh.write("datetime,v\n2024-01-01 00:00:00,5\n")
    assert archive.read_table(spark, plain, skip_rows="auto").first().v == 5


def test_ec_tower_rename_coalesces(spark):
    from towerfill.functions.constants import EC_TOWER_CO2
    from pyspark.sql import types as T
    names = ["date", "time (UTC)", EC_TOWER_CO2, "air temperature (degree_C) (T_40m_Avg)",
             "air temperature (degree_C) (T_1000cm_Avg)", "wind from direction (degree) (wind_dir)"]
    schema = T.StructType([T.StructField(n, T.StringType() if i < 2 else T.DoubleType()) for i, n in enumerate(names)])
    df = spark.createDataFrame([("01.02.2024", "03:04:05", 1.0, None, 7.0, 9.0)], schema)
    out, label = layouts.detect_layout(df)
    r = out.first()
    assert label == "EC Tower" and r.co2_flux == 1.0 and r.air_temperature == 7.0 and r.wind_dir == 9.0
    assert str(r.datetime) == "2024-02-01 03:04:05"

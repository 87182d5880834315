"""Readers on the inputs that broke them: column order, extra fields, quotes, stamp shapes, labels."""

from __future__ import annotations

import datetime as dt
import zipfile

import pytest

from towerfill.sources import archive, layouts, text


def put(folder, name, body):
    (folder / name).write_text(body)
    return str(folder)


def test_columns_go_by_name(spark, tmp_path):
    put(tmp_path, "a.csv", "datetime,x,y\n2024-01-01 00:00:00,1,2\n")
    put(tmp_path, "b.csv", "datetime,y,x\n2024-01-02 00:00:00,2,1\n")
    put(tmp_path, "c.csv", "datetime,y,z\n2024-01-03 00:00:00,2,9\n")
    rows = text.read_csv(spark, f"{tmp_path}/*.csv").orderBy("datetime").collect()
    assert [(r.x, r.y, r.z) for r in rows] == [(1, 2, None), (1, 2, None), (None, 2, 9)]


def test_extra_fields_raise_or_go(spark, tmp_path):
    path = put(tmp_path, "a.csv", "a,b\n1,2\n3,4,5\n6\n")
    with pytest.raises(ValueError, match="more fields"):
        text.read_csv(spark, path)
    rows = text.read_csv(spark, path, bad_rows="drop").orderBy("a").collect()
    assert [tuple(r) for r in rows] == [(1, 2), (6, None)]
    with pytest.raises(ValueError):
        archive.read_table(spark, put(tmp_path / "..", "x.csv", "a,b\n1,2\n3,4,5\n") + "/x.csv", skip_rows=0)


def test_quotes(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'a,b\n1,"x, y"\n2,"two\nlines"\n3,"say ""hi"""\n')
    rows = text.read_csv(spark, path).orderBy("a").collect()
    assert [r.b for r in rows] == ["x, y", "two\nlines", 'say "hi"']


def test_zip_with_quoted_commas_keeps_rows(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("t.csv", 'datetime,s\n2024-01-01 00:00:00,p\n2024-01-01 00:30:00,"a,b"\n2024-01-01 01:00:00,"c\nd"\n')
    rows = archive.read_table(spark, str(tmp_path), glob="*.zip").orderBy("datetime").collect()
    assert [r.s for r in rows] == ["p", "a,b", "c\nd"]


def test_one_header_with_and_without_quotes(spark, tmp_path):
    for name, body in (("a", '"t","v"\n"x, y",1\n'), ("b", "t,v\n"), ("c", "t,w\n")):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("t.csv", body)
    assert [tuple(r) for r in archive.read_table(spark, str(tmp_path), glob="[ab].zip").collect()] == [("x, y", 1)]
    with pytest.raises(ValueError, match="different headers"):
        archive.read_table(spark, str(tmp_path), glob="*.zip")


def test_archives_of_empty_partitions_have_the_same_header(spark, tmp_path):
    from towerfill.catalog import _write_zips
    df = spark.createDataFrame([(1, "x, y")], "a long, note string").repartition(3)
    _write_zips(spark, df, str(tmp_path / "z"), quoted=True)
    heads = set()
    for f in (tmp_path / "z").glob("*.zip"):
        with zipfile.ZipFile(f) as z:
            heads.add(z.read("data/tower.csv").splitlines()[2])
    assert heads == {b'"a","note"'}


def test_metadata_lines_are_found_by_any_longer_row(spark, tmp_path):
    put(tmp_path, "m.csv", "site,A\nmade,B\ndatetime,v,w\n2024-01-01 00:00:00,1,2\n")
    r = archive.read_table(spark, str(tmp_path)).first()
    assert (r.v, r.w) == (1, 2)


STAMPS = {"202401": dt.datetime(2024, 1, 1), "20240213": dt.datetime(2024, 2, 13), "2024021310": dt.datetime(2024, 2, 13, 10),
          "2024-02-13T10:00:00+02:00": dt.datetime(2024, 2, 13, 8), "2024-02-13 10:00:00Z": dt.datetime(2024, 2, 13, 10),
          "2024-02-13 10:00": dt.datetime(2024, 2, 13, 10), "13.02.2024 10:00": dt.datetime(2024, 2, 13, 10),
          "2024/2/13": dt.datetime(2024, 2, 13), "nonsense": None, "202413": None, "2024-02-30": None}


def test_stamp_shapes(spark):
    df = spark.createDataFrame([(s,) for s in STAMPS], "s string")
    got = {r.s: r.d for r in df.select("s", layouts.parse_auto(df["s"]).alias("d")).collect()}
    assert got == STAMPS


def test_day_first_is_the_columns(spark):
    def parse(*stamps):
        out, label = layouts.detect_layout(spark.createDataFrame([(s, 1) for s in stamps], "timestamp string, v int"))
        assert label == "GENERAL TIME SERIES"
        return sorted(str(r.datetime) for r in out.collect())
    assert parse("13/02/2024 10:00", "05/02/2024 10:00") == ["2024-02-05 10:00:00", "2024-02-13 10:00:00"]
    assert parse("02/13/2024", "05/02/2024") == ["2024-02-13 00:00:00", "2024-05-02 00:00:00"]


def test_error_labels(spark):
    df = spark.createDataFrame([("never", 1)], "timestamp string, v int")
    out, label = layouts.detect_layout(df)
    assert label == "UNKNOWN (failed time parse)" and out.first().datetime is None
    df = spark.createDataFrame([("x", "y", 1)], "TIMESTAMP_START string, TIMESTAMP_END string, v int")
    assert layouts.detect_layout(df)[1] == "FLUXNET (timestamp error)"


def test_a_stray_quote_in_a_zip_loses_no_row(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("t.csv", 'a,b\n1,5" pipe\n2,ok\n3,6" x 7" pipe\n4,ok\n')
    rows = archive.read_table(spark, str(tmp_path), glob="*.zip").orderBy("a").collect()
    assert [tuple(r) for r in rows] == [(1, '5" pipe'), (2, "ok"), (3, '6" x 7" pipe'), (4, "ok")]


def test_quoted_line_breaks_in_a_plain_file(spark, tmp_path):
    path = put(tmp_path, "a.csv", '1,"x\ny"\n')
    r = archive.read_table(spark, put(tmp_path, "a.csv", 'a,b\n1,"x\ny"\n2,z\n')).orderBy("a").collect()
    assert path and [tuple(x) for x in r] == [(1, "x\ny"), (2, "z")]


def test_a_quote_that_never_closes(spark, tmp_path):
    with pytest.raises(ValueError, match="never closes"):
        archive.read_table(spark, put(tmp_path, "a.csv", 'a,b\n1,"x\n2,y\n'), skip_rows=0)
    # the retry after two lines reads what is left
    rows = archive.read_table(spark, put(tmp_path, "a.csv", 'site,"A\nmade,B"\nmore "\na,b\n1,x\n')).collect()
    assert len(rows) >= 1


@pytest.mark.parametrize("line,out,inside", [("a,b", False, True), ('a,"b', True, False), ('a,"b"', False, False), ('5" x', False, False),
                                             ('"a""b', True, False), ('"a"x"y,"z', True, True), ('""', False, True), ('', False, True),
                                             ('","', False, True)])
def test_line_states(line, out, inside):
    from towerfill.sources.records import ends_inside
    assert (ends_inside(line, False), ends_inside(line, True)) == (out, inside)


@pytest.mark.parametrize("seed", range(2))
def test_records_over_many_splits_are_those_of_pandas(spark, tmp_path, seed):
    import csv
    import io
    import random

    import pandas as pd

    from towerfill.sources.records import text_records
    rng = random.Random(seed)
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(["k", "a", "b"])
    for i in range(100):
        w.writerow([i, *("".join(rng.choice(['x', 'y', ',', '"', '\n', ' ']) for _ in range(rng.randint(0, 12))) or "e" for _ in "ab")])
        if rng.random() < 0.1:
            out.write(f'{10_000 + i},5" pipe,q"r"\n')
    put(tmp_path, "a.csv", out.getvalue())
    put(tmp_path, "b.csv", "k,a,b\n1,2,3\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = text_records(spark, str(tmp_path)).filter("source LIKE '%a.csv'").orderBy("line_no").collect()
        table = archive.read_table(spark, str(tmp_path), glob="a.csv", skip_rows=0, infer=False).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.line_no for r in got] == list(range(1, len(got) + 1)) and not any(r.unclosed for r in got)
    want = list(csv.reader(io.StringIO(out.getvalue())))
    assert [next(csv.reader(io.StringIO(r.line))) for r in got] == want
    frame = pd.read_csv(tmp_path / "a.csv", dtype=str, keep_default_na=False)
    assert sorted(r.k for r in table) == sorted(frame["k"])


def test_members_of_one_archive_are_separate_tasks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(6):
            z.writestr(f"t{i}.csv", "a,b\n" + "".join(f"{j},{i}\n" for j in range(500)))
        z.writestr("notes.md", "x")
    members = archive.zip_records(spark, str(tmp_path))
    from pyspark.sql import functions as F
    tasks = members.withColumn("p", F.spark_partition_id()).groupBy("member").agg(F.collect_set("p").alias("p"), F.count("*").alias("n")).collect()
    assert {r.n for r in tasks} == {501} and len({tuple(r.p) for r in tasks}) == 6
    assert archive.read_table(spark, str(tmp_path), member="t3.csv").agg({"b": "max"}).first()[0] == 3


def test_many_headers_and_quoted_breaks_in_one_scan(spark, tmp_path):
    for i in range(30):
        put(tmp_path, f"f{i:02}.csv", f'k,c{i},"two\nlines"\n{i},v{i},"a\nb"\n\n{i + 100},5" x,\n')
    got = text.read_csv(spark, str(tmp_path))
    assert len(got.columns) == 32
    rows = {r.k: r for r in got.collect()}
    assert len(rows) == 60 and rows[7].c7 == "v7" and rows[7]["two\nlines"] == "a\nb" and rows[107].c7 == '5" x' and rows[7].c8 is None

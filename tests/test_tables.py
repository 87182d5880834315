"""The distributed dictionary, the record-level missing matrix and the ordered sink."""

from __future__ import annotations

import csv
import glob
import io
import random

import pytest
from pyspark.sql import functions as F

from towerfill.fixtures import TOWER
from towerfill.operators import profile
from towerfill.operators.encoding import apply_dictionary, apply_encoding, fit_dictionary, fit_encoding
from towerfill.sources.text import join_parts, read_csv, write_ordered_csv


def test_dictionary_codes_are_sorted_ranks(spark):
    rng = random.Random(1)
    rows = [(i, f"é{rng.randrange(3000)}" if i % 11 else None, rng.choice("zyx")) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, a string, b string").repartition(5)
    d = fit_dictionary(df, ["a", "b", "absent"], ranges=13)
    for c, k in (("a", 1), ("b", 2)):
        labels = sorted({r[k] or "nan" for r in rows} | {"nan"})
        got = {r.label: r.code for r in d.filter(F.col("column") == c).collect()}
        assert got == {v: i for i, v in enumerate(labels)}
    new = spark.createDataFrame([(1, None, "unseen"), (2, rows[1][1], "x")], "id long, a string, b string")
    codes = {r.label: r.code for r in d.filter("column = 'a'").collect()}
    low = {r.label: r.code for r in d.filter("column = 'b'").collect()}
    out = {r.id: (r.a, r.b) for r in apply_dictionary(new, d, ["a", "b"]).collect()}
    assert out == {1: (codes["nan"], low["nan"]), 2: (codes[rows[1][1]], low["x"])}
    small = fit_encoding(df, ["b"])
    a = apply_encoding(df, small).select("id", F.col("b").cast("long"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, apply_dictionary(df, d, ["b"]).select("id", "b").collect()))


def test_dictionary_of_nothing(spark):
    df = spark.createDataFrame([], "a string")
    assert [(r.column, r.label, r.code) for r in fit_dictionary(df, ["a"]).collect()] == [("a", "nan", 0)]
    assert fit_dictionary(df, ["z"]).count() == 0


def test_missing_bitmaps_over_block_ends(spark):
    n = 70_000
    df = spark.range(n).select(F.lit("s").alias("series_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("datetime"),
                               F.col("id").alias("event_id"), F.expr("if(id % 32768 IN (0, 7, 32767) OR id BETWEEN 40000 AND 40020, NULL, id)").alias("x"),
                               F.col("id").alias("full"))
    bits = profile.missing_bitmaps(df, ["x", "full"], TOWER).cache()
    assert {(r.block, r.records, r.full) for r in bits.collect()} == {(0, 32768, None), (1, 32768, None), (2, 4464, None)}
    want = [i for i in range(n) if i % 32768 in (0, 7, 32767) or 40000 <= i <= 40020]
    got = profile.missing_records(bits, ["x", "full"], ["series_id"]).collect()
    assert sorted(r.record for r in got) == want and {r.variable for r in got} == {"x"}
    part = profile.missing_records(bits, ["x", "full"], [], 32767, 40001).collect()
    assert sorted(r.record for r in part) == [i for i in want if 32767 <= i <= 40001]


def test_ordered_csv_is_one_file_in_order(spark, tmp_path):
    rows = [(i * 7919 % 500, f'q"{i}, x' if i % 3 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, `a,b` string").repartition(7)
    path = write_ordered_csv(df, f"{tmp_path}/out", ["k"], ranges=6)
    text = "".join(open(p, newline="").read() for p in sorted(glob.glob(f"{path}/part-*")))
    lines = list(csv.reader(io.StringIO(text), escapechar="\\"))
    assert lines[0] == ["k", "a,b"] and [int(r[0]) for r in lines[1:]] == list(range(500))
    with pytest.raises(NotImplementedError, match="parts in order"):  # the local file system can't
        join_parts(spark, path, f"{tmp_path}/one.csv")
    one = write_ordered_csv(df.limit(5), f"{tmp_path}/small", ["k"], ranges=1)
    assert open(join_parts(spark, one, f"{tmp_path}/one.csv")).read().startswith('k,"a,b"')
    empty = write_ordered_csv(df.limit(0), f"{tmp_path}/empty", ["k"])
    assert "".join(open(p).read() for p in glob.glob(f"{empty}/part-*")) == 'k,"a,b"\n'
    assert read_csv(spark, write_ordered_csv(df.select("k"), f"{tmp_path}/again", ["k"])).count() == 500

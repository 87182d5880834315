"""Label encoding fitted once and stored.

A column's vocabulary is the sorted distinct values as strings with ``nan`` for null,
and ``nan`` is always reserved, so rows with null or unseen values at apply time
get the code of ``nan`` instead of shifting other codes.

* ``fit_dictionary`` / ``apply_dictionary`` take any number of levels: the dictionary is a
  table (``column``, ``label``, ``code``). Distinct labels are range-partitioned and sorted,
  a label's code is its place in its range plus the labels of the ranges before, and
  the codes are joined back. Nothing is collected.
* ``fit_encoding`` / ``apply_encoding`` are for fixed label sets (8 stability classes, 16
  wind sectors), which travel with a model's metadata.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from towerfill.operators.sequence import join_on_keys
from towerfill.session import cut_lineage

NAN = "nan"


def fit_encoding(df: DataFrame, cols: Sequence[str], max_levels: int = 4096) -> dict[str, list[str]]:
    """Distinct levels per column, cut at ``max_levels + 1`` rows before anything is collected.

    Meant for columns with a bounded label set (the stability and wind-sector
    labels have 8 and 16); more than ``max_levels`` values is an error."""
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return {}
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.coalesce(F.col(c).cast("string"), F.lit(NAN)).alias("v"))
                                for c in cols])).alias("p")
    rows = df.select(pairs).select("p.c", "p.v").distinct().limit(len(cols) * max_levels + 1).collect()
    vocab = {}
    for c in cols:
        v = {r.v for r in rows if r.c == c} | {NAN}
        if len(v) > max_levels or len(rows) > len(cols) * max_levels:
            raise ValueError(f"{c} has more than {max_levels} distinct values; fit_dictionary takes any number")
        vocab[c] = sorted(v)
    return vocab


def apply_encoding(df: DataFrame, vocab: Mapping[str, Sequence[str]]) -> DataFrame:
    repl = {}
    for c, levels in vocab.items():
        if c not in df.columns:
            continue
        key = F.coalesce(F.col(c).cast("string"), F.lit(NAN))
        place = F.array_position(F.array(*[F.lit(v) for v in levels]), key)  # from 1; 0 if unseen
        repl[c] = F.coalesce(F.nullif(place, F.lit(0)) - 1, F.lit(list(levels).index(NAN))).cast("int")
    return df.withColumns(repl)


def _labels(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    every = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NAN)).alias("label")) for c in cols])
    reserved = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(NAN).alias("label")) for c in cols])
    spark = df.sparkSession
    rows = df.select(F.explode(every).alias("p")).unionByName(spark.range(1).select(F.explode(reserved).alias("p")))
    return rows.select("p.column", "p.label").distinct()


def fit_dictionary(df: DataFrame, cols: Sequence[str], ranges: int | None = None) -> DataFrame:
    """(``column``, ``label``, ``code``): codes count from 0 in each column's sorted labels, whatever their number.

    ``ranges`` overrides the number of range partitions. Columns that ``df`` lacks are skipped."""
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, label string, code long")
    keys = ["column", "label"]
    dealt = _labels(df, cols).repartitionByRange(*([ranges] if ranges else []), *keys).sortWithinPartitions(*keys)
    at = dealt.withColumn("_m", F.monotonically_increasing_id())
    placed = cut_lineage(at.select(*keys, F.shiftright("_m", 33).alias("_p"), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos")), "labels")
    before = Window.partitionBy("column").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("column", "_p").agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
    parts = parts.select("column", "_p", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return cut_lineage(join_on_keys(placed, parts, ["column", "_p"]).select(*keys, (F.col("_pos") + F.col("_shift")).alias("code")), "dictionary")


def apply_dictionary(df: DataFrame, dictionary: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``df`` with the codes of ``cols`` in their places; null and unseen values get the code of ``nan``."""
    out = df
    for i, c in enumerate(c for c in cols if c in df.columns):
        own = dictionary.filter(F.col("column") == c)
        nan = own.filter(F.col("label") == NAN).select("code").first()
        codes = own.select(F.col("label").alias(f"_l{i}"), F.col("code").alias(f"_c{i}"))
        label = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NAN))
        out = (out.join(codes, label == F.col(f"_l{i}"), "left").withColumn(c, F.coalesce(F.col(f"_c{i}"), F.lit(nan.code if nan else None)))
               .drop(f"_l{i}", f"_c{i}"))
    return out

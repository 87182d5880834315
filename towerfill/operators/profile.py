"""Profiling aggregates (G1-G8) and plan-time column lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from towerfill.functions.constants import EXCLUDE_PATTERNS, TIME_FEATURES
from towerfill.operators.quantiles import exact_quantiles
from towerfill.operators.sequence import INDEX, attach, index_rows, join_on_keys
from towerfill.timeline import Timeline

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, _NUMERIC)


# --- plan-time column lists ---------------------------------------------------------

def plot_columns(df: DataFrame) -> list[str]:
    """Every column but date, time, datetime and co2_flux_qc."""
    return [c for c in df.columns if c not in ("date", "time", "datetime", "co2_flux_qc")]


def outlier_columns(df: DataFrame, keys: Sequence[str] = ()) -> list[str]:
    """P4 (fixed, T9): numeric columns except date, time, datetime, month, keys and flag columns."""
    skip = {"date", "time", "datetime", "co2_flux_qc", "month", *keys}
    return [c for c in df.columns if c not in skip and is_numeric(df, c) and not is_flag(c)]


def is_flag(c: str) -> bool:
    return c.endswith("_qc") or c.startswith("qc_") or "flag" in c


def flux_columns(df: DataFrame) -> list[str]:
    """P5: names containing co2_flux, latent_heat_flux or sensible_heat_flux."""
    return [c for c in df.columns if any(f in c for f in ("co2_flux", "latent_heat_flux", "sensible_heat_flux"))]


def target_candidates(df: DataFrame) -> list[str]:
    """Every column but date, time, datetime."""
    return [c for c in df.columns if c not in ("date", "time", "datetime")]


def base_features(df: DataFrame, targets: Sequence[str], keys: Sequence[str] = ()) -> list[str]:
    """P7 (first half): source columns whose names contain none of the exclude patterns or targets."""
    pats = [*EXCLUDE_PATTERNS, *targets]
    return [c for c in df.columns if c not in keys and c not in targets and not any(p in c for p in pats)]


def time_features(df: DataFrame) -> list[str]:
    """The TIME model's features that exist and are numeric."""
    return [c for c in TIME_FEATURES if c in df.columns and is_numeric(df, c)]


# --- aggregates ----------------------------------------------------------------------

def table_shape(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """G1: row count and column count."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_cols"))


def missing_summary(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Null count and percent (2 decimals, half-even like pandas) per column, worst first."""
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.count(F.when(F.col(c).isNull(), 1)).alias(f"_m{i}")
                                              for i, c in enumerate(cols)]
    wide = df.groupBy(*by).agg(*aggs)
    stack = "stack({}, {}) as (variable, missing)".format(
        len(cols), ", ".join(f"'{c}', _m{i}" for i, c in enumerate(cols)))
    long = wide.selectExpr(*by, "_n", stack)
    return (long.select(*by, "variable", "missing",
                        F.bround(F.col("missing") / F.col("_n") * 100, 2).alias("pct"))
                .orderBy(*by, F.desc("missing"), "variable"))


def missing_matrix(df: DataFrame, cols: Sequence[str], time_col: str, unit: str = "day",
                   by: Sequence[str] = ()) -> DataFrame:
    """Share of null values per variable and time bucket (the heatmap's data)."""
    wide = df.groupBy(*by, F.date_trunc(unit, time_col).cast("timestamp_ntz").alias("bucket")).agg(
        *[F.avg(F.col(f"`{c}`").isNull().cast("int")).alias(f"_m{i}") for i, c in enumerate(cols)])
    stack = "stack({}, {}) as (variable, missing_frac)".format(len(cols), ", ".join(f"'{c}', _m{i}" for i, c in enumerate(cols)))
    return wide.selectExpr(*[f"`{b}`" for b in by], "bucket", stack).select(*by, "variable", "bucket", "missing_frac")


def missing_bitmaps(df: DataFrame, cols: Sequence[str], tl: Timeline) -> DataFrame:
    """G3 by record: per series and block of 32768 records a bitmap of the null records of each variable.

    ``block`` counts from 0; ``records`` are the block's records; a variable without
    nulls in a block has no bitmap (null), so long complete stretches cost nothing. The
    bitmaps are merged from partial ones by Spark's bitmap aggregate."""
    x = index_rows(df.select(*tl.keys, *[F.col(f"`{c}`") for c in cols if c not in tl.keys]), tl)
    at = F.col(INDEX) + 1
    null = [F.when(F.col(f"`{c}`").isNull(), F.bitmap_bit_position(at)) for c in cols]
    return x.groupBy(*tl.series, (F.bitmap_bucket_number(at) - 1).alias("block")).agg(
        F.count(F.lit(1)).alias("records"),
        *[F.when(F.count(p) > 0, F.bitmap_construct_agg(p)).alias(c) for c, p in zip(cols, null)])


def missing_records(bitmaps: DataFrame, cols: Sequence[str], by: Sequence[str] = (), first: int = 0, last: int | None = None) -> DataFrame:
    """The null cells (``variable``, ``record``) of the records ``first`` to ``last`` drawn from the bitmaps; other blocks aren't read."""
    size = 8 * 4096
    near = bitmaps.filter((F.col("block") >= first // size) & (F.lit(True) if last is None else F.col("block") <= last // size))
    every = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").alias("bits")) for c in cols])
    cells = near.select(*by, "block", F.explode(every).alias("v")).select(*by, "block", "v.variable", F.hex("v.bits").alias("h")).filter("h IS NOT NULL")
    # a byte is two digits; bytes of 0 are skipped before their bits are looked at
    used = F.expr("filter(sequence(0, length(h) div 2 - 1), i -> substr(h, 2 * i + 1, 2) <> '00')")
    cells = cells.select(*by, "block", "variable", "h", F.explode(used).alias("i"))
    byte = F.expr("CAST(conv(substr(h, 2 * i + 1, 2), 16, 10) AS INT)")
    bit = F.explode(F.expr("filter(sequence(0, 7), b -> (shiftright(_byte, b) & 1) = 1)"))
    cells = cells.select(*by, "block", "variable", "i", byte.alias("_byte")).select(*by, "block", "variable", "i", bit.alias("b"))
    out = cells.select(*by, "variable", (F.col("block") * size + F.col("i") * 8 + F.col("b")).alias("record"))
    return out.filter((F.col("record") >= first) & (F.lit(True) if last is None else F.col("record") <= last))


def head(df: DataFrame, order: Sequence[str], n: int, by: Sequence[str] = ()) -> DataFrame:
    """L2: first n rows (per group).  Spark plans a partial top-n before the shuffle."""
    from pyspark.sql import Window
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def value_histogram(df: DataFrame, col: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over [min, max], last bin closed; empty bins omitted."""
    x = df.select(*by, F.col(col).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    rng = x.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    y = attach(x, rng, list(by))
    width = (F.col("_hi") - F.col("_lo")) / bins
    idx = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor(F.try_divide(F.col("_v") - F.col("_lo"), width)), F.lit(bins - 1))).cast("int")
    y = y.withColumn("bin", idx)
    return (y.groupBy(*by, "bin", "_lo", "_hi")
             .agg(F.count(F.lit(1)).alias("count"))
             .select(*by, "bin", (F.col("_lo") + F.col("bin") * width).alias("lower"),
                     F.when(F.col("bin") == bins - 1, F.col("_hi"))
                      .otherwise(F.col("_lo") + (F.col("bin") + 1) * width).alias("upper"), "count"))


BOX_PROBS = [0.0, 0.25, 0.5, 0.75, 1.0]
BOX_NAMES = ["min", "q1", "median", "q3", "max"]


def box_stats(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """G5 box marginal / G7 box: min, quartiles, max (exact) and count."""
    by = list(by)
    q = exact_quantiles(df, by, col, BOX_PROBS, BOX_NAMES)
    n = df.groupBy(*by).agg(F.count(col).alias("count"))
    return attach(q, n, by)


def monthly_box(df: DataFrame, col: str, time_col: str, series: Sequence[str] = (), min_rows: int = 28) -> DataFrame:
    """Box statistics per month, only for series with more than ``min_rows`` rows."""
    series = list(series)
    x = df.withColumn("month", F.month(time_col))
    big = x.groupBy(*series).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > min_rows).drop("_rows")
    if series:
        x = join_on_keys(x, big, series, "left_semi")
    return box_stats(x, col, [*series, "month"])


def diurnal(df: DataFrame, col: str, time_col: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean by hour of day."""
    return df.groupBy(*by, F.hour(time_col).alias("hour")).agg(F.avg(col).alias(f"{col}_mean"))


def qc_range(df: DataFrame, flags: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Min and max of each flag column and the default limit ``min(max, 1)``."""
    aggs = []
    for c in flags:
        aggs += [F.min(c).alias(f"_min_{c}"), F.max(c).alias(f"_max_{c}")]
    wide = df.groupBy(*by).agg(*aggs)
    stack = "stack({}, {}) as (flag, qc_min, qc_max)".format(
        len(flags), ", ".join(f"'{c}', CAST(_min_{c} AS BIGINT), CAST(_max_{c} AS BIGINT)" for c in flags))
    long = wide.selectExpr(*by, stack)
    return long.withColumn("default_limit", F.least(F.col("qc_max"), F.lit(1).cast("long")))

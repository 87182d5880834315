"""Gap analysis: runs of consecutive null rows.

A gap is a null in an existing row; a missing timestamp is not a gap.  For a
null row at position ``g`` with ``nb`` nulls at or before it, ``g - nb`` is
constant along a run and differs between runs, so runs are a plain
``groupBy`` (partial aggregation, no series-wide sort) over the numbered rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from towerfill.operators.sequence import INDEX, index_rows
from towerfill.timeline import Timeline


def gap_runs(df: DataFrame, tl: Timeline, column: str) -> DataFrame:
    """One row per run of nulls in ``column``: series keys, ``variable``,
    ``start_idx`` (0-based row position), ``length`` (rows), first and last time."""
    x = index_rows(df.select(*tl.keys, column), tl, count_nulls_of=[column])
    nulls = x.filter(F.col(column).isNull()).withColumn("_run", F.col(INDEX) - F.col(f"_nb_{column}"))
    return (nulls.groupBy(*tl.series, "_run")
                 .agg(F.min(INDEX).alias("start_idx"), F.count(F.lit(1)).alias("length"),
                      F.min(tl.time).alias("start_time"), F.max(tl.time).alias("end_time"))
                 .drop("_run")
                 .withColumn("variable", F.lit(column))
                 .select(*tl.series, "variable", "start_idx", "length", "start_time", "end_time"))


def gap_summary(runs: DataFrame, tl: Timeline) -> DataFrame:
    """Number of gaps, mean / median / max length per series and variable.

    The median uses Spark's exact ``percentile``; its state is a map over the
    distinct run lengths, and distinct lengths summing to at most N rows number
    at most sqrt(2N), so the per-group state stays small for any N.
    """
    return (runs.groupBy(*tl.series, "variable")
                .agg(F.count(F.lit(1)).alias("gap_count"),
                     F.avg("length").alias("mean_length"),
                     F.percentile(F.col("length"), F.lit(0.5)).alias("median_length"),
                     F.max("length").alias("max_length")))


def gap_histogram(runs: DataFrame, tl: Timeline) -> DataFrame:
    """How many gaps have each length."""
    return runs.groupBy(*tl.series, "variable", "length").agg(F.count(F.lit(1)).alias("gaps"))

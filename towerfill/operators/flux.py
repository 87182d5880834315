"""Flux analytics (X1-X13): energy balance, carbon budget, Bowen ratio.

All are per-series aggregates over the (gap-filled) table; with ``by=()``
the whole table is one series, as in the reference.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from towerfill.functions import flux as fx
from towerfill.functions.calendar import days_in_month, month_name
from towerfill.functions.constants import CARBON_FACTOR

H, LE, CO2 = "sensible_heat_flux", "latent_heat_flux", "co2_flux"


def energy_balance(df: DataFrame, time_col: str = "datetime", keep: Sequence[str] = ()) -> DataFrame:
    """Datetime, Rnet, H, LE, H + LE and the residual Rnet - (H + LE)."""
    rn = fx.net_radiation(*[F.col(c) for c in fx.RAD_PARTS])
    eb = fx.energy_balance(F.col(H), F.col(LE))
    return df.select(*keep, time_col, rn.alias("Rnet"), H, LE, eb.alias("energy_balance"),
                     (rn - eb).alias("residual"))


def closure_regression(eb: DataFrame, by: Sequence[str] = (), min_pairs: int = 10) -> DataFrame:
    """Least squares of H+LE on Rnet over complete pairs (needs more than ``min_pairs``),
    with the end points of the fitted line and of the 1:1 line."""
    y, x = F.col("energy_balance"), F.col("Rnet")
    pair = x.isNotNull() & y.isNotNull()
    r = eb.groupBy(*by).agg(
        F.regr_count(y, x).alias("n_pairs"), F.regr_slope(y, x).alias("_slope"),
        F.regr_intercept(y, x).alias("_icpt"), F.regr_r2(y, x).alias("_r2"),
        F.min(F.when(pair, x)).alias("_xmin"), F.max(F.when(pair, x)).alias("_xmax"),
        F.min(F.when(pair, y)).alias("_ymin"), F.max(F.when(pair, y)).alias("_ymax"))
    ok = F.col("n_pairs") > min_pairs
    slope, icpt = F.col("_slope"), F.col("_icpt")
    return r.select(
        *by, "n_pairs",
        F.when(ok, slope).alias("slope"), F.when(ok, icpt).alias("intercept"), F.when(ok, F.col("_r2")).alias("r2"),
        F.when(ok, F.col("_xmin")).alias("x_min"), F.when(ok, F.col("_xmax")).alias("x_max"),
        F.when(ok, slope * F.col("_xmin") + icpt).alias("line_y_min"),
        F.when(ok, slope * F.col("_xmax") + icpt).alias("line_y_max"),
        F.when(ok, F.least("_xmin", "_ymin")).alias("one_to_one_min"),
        F.when(ok, F.greatest("_xmax", "_ymax")).alias("one_to_one_max"))


def closure_ratio(eb: DataFrame, by: Sequence[str] = (), paired: bool = False) -> DataFrame:
    """sum(H+LE) / sum(Rnet), each sum over its own non-null rows (T18; ``paired``
    restricts both to complete pairs), and the mean residual."""
    y, x = F.col("energy_balance"), F.col("Rnet")
    if paired:
        ok = x.isNotNull() & y.isNotNull()
        y, x = F.when(ok, y), F.when(ok, x)
    return eb.groupBy(*by).agg(F.try_divide(F.sum(y), F.sum(x)).alias("ebr"),
                               F.avg("residual").alias("mean_residual"))


def diurnal_stats(df: DataFrame, col: str, time_col: str = "datetime", by: Sequence[str] = ()) -> DataFrame:
    """Mean, sample std and the mean +- std band by hour."""
    g = df.groupBy(*by, F.hour(time_col).alias("hour")).agg(F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"))
    return g.select("*", (F.col("mean") + F.col("std")).alias("upper"), (F.col("mean") - F.col("std")).alias("lower"))


def monthly_mean(df: DataFrame, col: str, time_col: str = "datetime", by: Sequence[str] = ()) -> DataFrame:
    """Mean per calendar month with its short name (L3: order by month number)."""
    g = df.groupBy(*by, F.month(time_col).alias("month")).agg(F.avg(col).alias(col))
    return g.select(*by, "month", col, month_name(F.col("month")).alias("month_name")).orderBy(*by, "month")


def carbon_budget(df: DataFrame, time_col: str = "datetime", by: Sequence[str] = (),
                  factor: float = CARBON_FACTOR) -> DataFrame:
    """Monthly mean and count of co2_flux, gC_m2_day = mean * factor, days (Feb = 28), gC_m2_month."""
    g = df.groupBy(*by, F.month(time_col).alias("month")).agg(F.avg(CO2).alias("mean"), F.count(CO2).alias("count"))
    day = F.col("mean") * factor
    days = days_in_month(F.col("month"))
    return g.select(*by, "month", "mean", "count", day.alias("gC_m2_day"), days.alias("days"),
                    (day * days).alias("gC_m2_month"), month_name(F.col("month")).alias("month_name")
                    ).orderBy(*by, "month")


def carbon_annual(budget: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Annual budget = sum of monthly totals; negative is a sink, else a source."""
    a = budget.groupBy(*by).agg(F.sum("gC_m2_month").alias("annual_gC_m2"))
    return a.withColumn("status", F.when(F.col("annual_gC_m2") < 0, "sink").otherwise("source"))


def bowen_series(df: DataFrame, time_col: str = "datetime", keep: Sequence[str] = ()) -> DataFrame:
    """The Bowen ratio column if present, else H / LE."""
    br = F.col("bowen_ratio") if "bowen_ratio" in df.columns else fx.bowen(F.col(H), F.col(LE))
    return df.select(*keep, time_col, br.alias("bowen_ratio"))


def bowen_filtered(series: DataFrame) -> DataFrame:
    """Keep -10 < ratio < 10 (null ratios drop out, like inf and NaN)."""
    return series.filter((F.col("bowen_ratio") > -10) & (F.col("bowen_ratio") < 10))


def flux_parts(df: DataFrame) -> list[str]:
    """The parts of the flux report whose columns are there, as in the reference."""
    have = set(df.columns)
    needs = {"energy": {*fx.RAD_PARTS, H, LE}, "carbon": {CO2}, "bowen": {H, LE}}
    return [part for part, cols in needs.items() if cols <= have]


def flux_report(df: DataFrame, time_col: str = "datetime", by: Sequence[str] = ()) -> dict[str, DataFrame]:
    """One table per part that the columns allow (an absent column skips its part): closure ratio, annual budget, and the
    mean of the screened Bowen ratio."""
    out: dict[str, DataFrame] = {}
    parts = flux_parts(df)
    if "energy" in parts:
        out["energy"] = closure_ratio(energy_balance(df, time_col, by), by)
    if "carbon" in parts:
        out["carbon"] = carbon_annual(carbon_budget(df, time_col, by), by)
    if "bowen" in parts:
        out["bowen"] = bowen_filtered(bowen_series(df, time_col, by)).groupBy(*by).agg(F.avg("bowen_ratio").alias("mean_bowen"))
    return out

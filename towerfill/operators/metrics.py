"""Evaluation metrics (M9-M12, C27), all single-pass aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from towerfill.functions.flux import residual
from towerfill.operators.profile import value_histogram


def regression_metrics(df: DataFrame, observed: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """N, MAE, RMSE, R^2 = 1 - SSE / SST and the slope of predicted on observed."""
    y, p = F.col(observed), F.col(predicted)
    both = y.isNotNull() & p.isNotNull()
    r = F.when(both, residual(y, p))
    g = df.groupBy(*by).agg(
        F.count(r).alias("n"), F.avg(F.abs(r)).alias("mae"), F.sqrt(F.avg(r * r)).alias("rmse"),
        F.sum(r * r).alias("_sse"), F.var_pop(F.when(both, y)).alias("_var"),
        F.regr_slope(p, y).alias("slope"))
    r2 = 1 - F.try_divide(F.col("_sse"), F.col("n") * F.col("_var"))
    return g.select(*by, "n", "mae", "rmse", r2.alias("r2"), "slope")


def residual_histogram(df: DataFrame, residual_col: str = "residual", bins: int = 30,
                       by: Sequence[str] = ()) -> DataFrame:
    """Residuals in up to 30 equal-width bins."""
    return value_histogram(df, residual_col, bins, by)


def pair_range(df: DataFrame, observed: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """The common range of observed and predicted (ends of the 1:1 line)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                               F.least(F.min(observed), F.min(predicted)).alias("min_val"),
                               F.greatest(F.max(observed), F.max(predicted)).alias("max_val"))

"""Shift and rolling features (W1-W4), exact per series and split across tasks.

All shift and rolling columns of one call share a single window specification,
so Spark plans one exchange, one sort and one Window node for all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from towerfill.functions.constants import ROLLING_STATS, ROLLING_WINDOWS, SHIFT_PERIODS
from towerfill.operators.sequence import with_window_columns
from towerfill.timeline import Timeline

_STATS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def _check(stats: Sequence[str]) -> None:
    for s in stats:
        if s not in _STATS:
            raise ValueError(f"Invalid statistic: {s}")


def shift_exprs(w: Window, cols: Sequence[str], periods: Sequence[int], direction: str) -> list[Column]:
    """``{c}_lag_{k}``.  Note: the default ``backward`` direction reads the row k
    places *later* (the reference's ``shift(-k)``); ``forward`` reads k places earlier."""
    ahead = direction.lower() != "forward"
    return [(F.lead(c, k) if ahead else F.lag(c, k)).over(w).alias(f"{c}_lag_{k}") for c in cols for k in periods]


def rolling_exprs(w: Window, cols: Sequence[str], windows: Sequence[int], stats: Sequence[str],
                  end: int = 0) -> list[Column]:
    """``{c}_rolling_{n}_{stat}`` over the trailing n rows ending ``end`` rows from the current one
    (0: including it, as the reference; -1: the n rows before it)."""
    _check(stats)
    return [_STATS[s](c).over(w.rowsBetween(-(n - 1) + end, end)).alias(f"{c}_rolling_{n}_{s}")
            for c in cols for n in windows for s in stats]


def add_window_features(df: DataFrame, tl: Timeline, shift_cols: Sequence[str] = (),
                        periods: Sequence[int] = tuple(SHIFT_PERIODS), direction: str = "backward",
                        rolling_cols: Sequence[str] = (), windows: Sequence[int] = tuple(ROLLING_WINDOWS),
                        stats: Sequence[str] = tuple(ROLLING_STATS), rolling_end: int = 0) -> DataFrame:
    """Shift features of ``shift_cols`` and rolling stats of ``rolling_cols`` in one pass.

    Absent columns are skipped, as in the reference."""
    _check(stats)
    shift_cols = [c for c in shift_cols if c in df.columns]
    rolling_cols = [c for c in rolling_cols if c in df.columns]
    if not shift_cols and not rolling_cols:
        return df
    fwd = direction.lower() == "forward"
    reach = max(periods) if (shift_cols and periods) else 0
    ahead = 0 if fwd else reach
    behind = max([reach if fwd else 0] + ([max(windows) - 1 - rolling_end] if rolling_cols and windows else []))

    def build(w):
        return (shift_exprs(w, shift_cols, periods, direction)
                + rolling_exprs(w, rolling_cols, windows, stats, rolling_end))

    return with_window_columns(df, tl, ahead, behind, build)


def add_shift_features(df: DataFrame, tl: Timeline, cols: Sequence[str],
                       periods: Sequence[int] = tuple(SHIFT_PERIODS), direction: str = "backward") -> DataFrame:
    """W1 (``create_lag_features``)."""
    return add_window_features(df, tl, shift_cols=cols, periods=periods, direction=direction)


def add_rolling_features(df: DataFrame, tl: Timeline, cols: Sequence[str],
                         windows: Sequence[int] = tuple(ROLLING_WINDOWS),
                         stats: Sequence[str] = ("mean", "std", "min", "max")) -> DataFrame:
    """W2-W4 (``create_rolling_features``)."""
    return add_window_features(df, tl, rolling_cols=cols, windows=windows, stats=stats)

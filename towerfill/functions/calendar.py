"""Calendar features from the time column."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from towerfill.functions.constants import DAYS_IN_MONTH, MONTH_NAMES

TWO_PI = 2 * math.pi

CYCLE_PERIODS = [("hour", 24), ("month", 12), ("dayofyear", 365.25), ("weekday", 7), ("quarter", 4),
                 ("weekofyear", 52)]


def base_parts(ts: Column) -> list[Column]:
    """Hour, day, month, year, dayofyear, weekday (Mon=0), quarter, ISO week, is_weekend."""
    return [
        F.hour(ts).alias("hour"), F.dayofmonth(ts).alias("day"), F.month(ts).alias("month"),
        F.year(ts).alias("year"), F.dayofyear(ts).alias("dayofyear"), F.weekday(ts).alias("weekday"),
        F.quarter(ts).alias("quarter"), F.weekofyear(ts).alias("weekofyear"),
        (F.weekday(ts) >= 5).cast("int").alias("is_weekend"),
    ]


def cyclical(parts: dict[str, Column]) -> list[Column]:
    """sin/cos pairs of each calendar part over its period (12 columns)."""
    out = []
    for name, period in CYCLE_PERIODS:
        x = parts[name]
        out.append(F.sin(TWO_PI * x / period).alias(f"{name}_sin"))
        out.append(F.cos(TWO_PI * x / period).alias(f"{name}_cos"))
    return out


def season(month: Column) -> Column:
    """Dec-Feb 0, Mar-May 1, Jun-Aug 2, Sep-Nov 3."""
    return F.floor(F.pmod(month, F.lit(12)) / 3).cast("int")


def day_part_flags(hour: Column) -> list[Column]:
    """Morning 6-11, afternoon 12-17, evening 18-21, night 22-5."""
    return [((hour >= 6) & (hour < 12)).cast("int").alias("is_morning"),
            ((hour >= 12) & (hour < 18)).cast("int").alias("is_afternoon"),
            ((hour >= 18) & (hour < 22)).cast("int").alias("is_evening"),
            ((hour >= 22) | (hour < 6)).cast("int").alias("is_night")]


def add_time_features(df: DataFrame, time_col: str = "datetime") -> DataFrame:
    """``create_time_features``: C1-C9 in one projection (season dummies always all four, T13)."""
    ts = F.col(time_col)
    base = base_parts(ts)
    df = df.select("*", *base)
    parts = {c: F.col(c) for c in ("hour", "month", "dayofyear", "weekday", "quarter", "weekofyear")}
    extra = cyclical(parts)
    extra.append((F.col("hour") + F.minute(ts) / 60.0).alias("hour_decimal"))
    extra.append(season(F.col("month")).alias("season"))
    df = df.select("*", *extra)
    dummies = [(F.col("season") == i).cast("int").alias(f"season_{i}") for i in range(4)]
    return df.select("*", *dummies, *day_part_flags(F.col("hour")))


def pick(values: list, index0: Column) -> Column:
    """``values[index0]``; null or out-of-range index gives null.

    (Spark 4.1's ``element_at`` over a literal array returned the last element for a
    null CASE-built index, so lookups avoid it.)"""
    return F.get(F.array(*[F.lit(v) for v in values]), index0)


def month_name(month: Column) -> Column:
    """Short month name by lookup."""
    return pick(MONTH_NAMES, month.cast("int") - 1)


def days_in_month(month: Column) -> Column:
    """Days per month with February = 28, as the carbon budget uses."""
    return pick(DAYS_IN_MONTH, month.cast("int") - 1)

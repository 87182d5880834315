"""Helpers shared by the operators: table access, word columns and a size-checked broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from towerfill.session import cut_lineage

#: Fixed by the contracts: what separates words.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The runs of non-space characters of ``text``, unchanged; null and blank text have none."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RUN))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once (bound to a lambda variable)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def small_side(df: DataFrame, name: str, size: Column, max_bytes: int) -> tuple[DataFrame, bool]:
    """``df`` written once to the shared folder, and whether the sum of ``size`` over its rows is at most ``max_bytes``.

    If so it carries a broadcast hint; else the plain table comes back and the
    join shuffles.
    """
    kept = cut_lineage(df, name)
    fits = (kept.agg(F.sum(size)).first()[0] or 0) <= max_bytes
    return (F.broadcast(kept) if fits else kept), fits

"""Artificial gaps for evaluation (M1-M4).

For each target, exactly ``floor(n_valid * p)`` non-null cells per series are
nulled (``n_valid`` counted per series).  Each row gets a seeded uniform ``u``
from an MD5 hash of ``(seed, row key)``, so the choice does not depend on
partitioning and survives task retries:

* MCAR: the cells with the smallest ``u``;
* MAR / MNAR: weighted sampling without replacement (Efraimidis and Spirakis,
  2006): the smallest ``-ln(u) / w``, with ``w`` the min-max scaled ``|x|`` + 0.1 of
  the driving column (another column for MAR, the target itself for MNAR);
  a constant column gives ``w = 1``; a null driving value gets the floor 0.1.

"The n smallest keys" is found without sorting a series in one task: a histogram
of keys per series (about sqrt(n) buckets) gives the bucket that holds the n-th
key, only that bucket's rows are ranked, and the exact threshold key is then a
filter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from towerfill.operators.sequence import attach
from towerfill.session import cut_lineage

HASH_SCALE = float(1 << 52)


def seeded_uniform(seed: int, key_cols: Sequence[str]) -> Column:
    """u in (0, 1) from the first 13 hex digits of md5('{seed}:{key}')."""
    parts = [F.col(c).cast("string") for c in key_cols]
    text = F.concat_ws(":", F.lit(str(seed)), *parts)
    h = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (h + 0.5) / HASH_SCALE


def _weights(df: DataFrame, valid: Column, dep: str, by: list[str]) -> tuple[DataFrame, Column]:
    a = F.abs(F.col(dep).cast("double"))
    st = df.filter(valid).groupBy(*by).agg(F.min(a).alias("_wlo"), F.max(a).alias("_whi"))
    x = attach(df, st, by)
    lo, hi = F.col("_wlo"), F.col("_whi")
    w = F.when(hi == lo, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(a - lo, hi - lo) + 0.1, F.lit(0.1)))
    return x, w


def mark_smallest(df: DataFrame, by: list[str], tiebreak: list[str], bins: int = 1 << 20) -> DataFrame:
    """Add boolean ``_sel``: row is among the ``_n`` smallest ``(_key, tiebreak)`` of its group.

    ``df`` carries ``_key`` (null = not eligible), ``_unit`` (``_key`` mapped monotonically
    into [0, 1)), ``_n`` (quota per group) and optionally ``_nbins`` (buckets per group,
    default ``bins``), each equal on every row of the group."""
    order = [F.col("_key").asc_nulls_last(), *[F.col(c) for c in tiebreak]]
    nb = F.col("_nbins") if "_nbins" in df.columns else F.lit(bins)
    x = df.withColumn("_bk", F.least(F.floor(F.col("_unit") * nb), nb - 1).cast("long"))
    el = x.filter(F.col("_key").isNotNull())
    hist = el.groupBy(*by, "_bk").agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    hist = hist.withColumn("_before", F.coalesce(F.sum("_c").over(
        Window.partitionBy(*by).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    edge = hist.filter((F.col("_before") < F.col("_n")) & (F.col("_before") + F.col("_c") >= F.col("_n")))
    edge = edge.select(*by, F.col("_bk").alias("_edge"), (F.col("_n") - F.col("_before")).alias("_need"))
    # Rank only the rows of the boundary bucket.
    inb = attach(el, edge, by, "inner").filter(F.col("_bk") == F.col("_edge"))
    inb = inb.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    keycols = [F.col("_key"), *[F.col(c) for c in tiebreak]]
    thr = inb.filter(F.col("_r") == F.col("_need")).select(
        *by, "_edge", F.struct(*[c.alias(f"_t{i}") for i, c in enumerate(keycols)]).alias("_thr"))
    y = attach(x, cut_lineage(thr, "thresholds") if by else thr, by)  # a row per group, its size known before the join is planned
    me = F.struct(*[c.alias(f"_t{i}") for i, c in enumerate(keycols)])
    sel = F.col("_key").isNotNull() & F.col("_edge").isNotNull() & (
        (F.col("_bk") < F.col("_edge")) | ((F.col("_bk") == F.col("_edge")) & (me <= F.col("_thr"))))
    return y.withColumn("_sel", F.coalesce(sel, F.lit(False))).drop("_bk", "_edge", "_thr", "_nbins")


def artificial_gaps(df: DataFrame, targets: Sequence[str], p: float = 0.2, mechanism: str = "MCAR",
                    dependency: str | None = None, seed: int = 42, row_key: Sequence[str] = (),
                    by: Sequence[str] = (), flag_prefix: str = "masked_") -> DataFrame:
    """Null ``floor(n_valid * p)`` cells of each target per group; add ``{flag_prefix}{target}`` (0/1)."""
    by, row_key = list(by), list(row_key)
    if not row_key:
        raise ValueError("row_key must name columns that identify a row")
    mech = mechanism.upper()
    u = seeded_uniform(seed, row_key)
    out = df
    for i, t in enumerate([c for c in targets if c in df.columns]):
        if i:  # cut lineage so each target's plan does not re-run the previous ones
            out = cut_lineage(out, "masked")
        valid = F.col(t).isNotNull()
        drive = dependency if mech == "MAR" and dependency and dependency in df.columns else (t if mech == "MNAR" else None)
        cols = out.columns
        if drive is None:
            x = out.withColumn("_key", F.when(valid, u)).withColumn("_unit", F.col("_key"))
        else:
            x, w = _weights(out, valid, drive, by)
            key = -F.log(u) / w
            x = x.withColumn("_key", F.when(valid, key)).withColumn("_unit", 1.0 - F.exp(-F.col("_key")))
        quota = x.filter(valid).groupBy(*by).agg(F.count(F.lit(1)).alias("_valid"))
        quota = cut_lineage(quota.select(
            *by, F.floor(F.col("_valid") * float(p)).cast("long").alias("_n"),
            F.greatest(F.lit(1), F.floor(F.sqrt("_valid"))).cast("long").alias("_nbins")), "quota")
        x = attach(x, quota, by)
        x = mark_smallest(x, by, row_key)
        out = x.select(*[F.when(F.col("_sel"), F.lit(None)).otherwise(F.col(c)).alias(c) if c == t else F.col(f"`{c}`")
                         for c in cols],
                       F.col("_sel").cast("int").alias(f"{flag_prefix}{t}"))
    return out

"""Quality screening: QC-flag filter (P9) and outlier rules.

Each screen nulls the value and keeps the row.  Thresholds are small per-group
aggregates (one row per series and variable) joined back to the rows.
Tests compare without dividing (T10), so zero spread needs no special case.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from towerfill.operators.profile import flux_columns, outlier_columns
from towerfill.operators.quantiles import quantile_table
from towerfill.operators.sequence import attach, join_on_keys


def default_qc_pairs(df: DataFrame) -> dict[str, str]:
    """Flux column -> its flag column, accepting ``{flux}_qc`` and ``qc_{flux}``."""
    out = {}
    for c in flux_columns(df):
        if c.endswith("_qc") or c.startswith("qc_"):
            continue
        for f in (f"{c}_qc", f"qc_{c}"):
            if f in df.columns:
                out[c] = f
                break
    return out


def qc_filter(df: DataFrame, limits: Mapping[str, tuple[str, int]]) -> DataFrame:
    """``{flux: (flag, limit)}``; null where flag > limit; a null flag keeps the value."""
    repl = {flux: F.when(F.coalesce(F.col(flag) > F.lit(lim), F.lit(False)), F.lit(None)).otherwise(F.col(flux))
            for flux, (flag, lim) in limits.items()}
    return df.withColumns(repl)


def _widen(th: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Thresholds by (group, variable) as one row per group: ``_th_{i}_{name}``."""
    names = [c for c in th.columns if c not in (*by, "variable")]
    place = F.create_map(*[F.lit(x) for i, c in enumerate(cols) for x in (c, i)])
    return th.withColumn("_i", place[F.col("variable")]).groupBy(*by).agg(
        *[F.expr(f"max(if(_i = {i}, `{n}`, NULL))").alias(f"_th_{i}_{n}") for i in range(len(cols)) for n in names])


def _apply(df: DataFrame, wide: DataFrame, names: Sequence[str], cols: Sequence[str], by: Sequence[str], flag) -> DataFrame:
    """Attach the thresholds (one row per group) and null flagged values."""
    x = attach(df, wide, list(by))
    out = {}
    for i, c in enumerate(cols):
        t = {n: F.col(f"_th_{i}_{n}") for n in names}
        out[c] = F.when(F.coalesce(flag(F.col(f"`{c}`"), t), F.lit(False)), F.lit(None)).otherwise(F.col(f"`{c}`"))
    return x.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in df.columns])


def iqr_thresholds(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return quantile_table(df, by, {c: F.col(f"`{c}`") for c in cols}, [0.25, 0.75], ["q1", "q3"])


def outlier_iqr(df: DataFrame, cols: Sequence[str] | None = None, k: float = 1.5,
                by: Sequence[str] = ()) -> DataFrame:
    """O1: null values below Q1 - k*IQR or above Q3 + k*IQR."""
    cols = list(cols) if cols is not None else outlier_columns(df, by)
    th = iqr_thresholds(df, cols, by)

    def flag(x, t):
        iqr = t["q3"] - t["q1"]
        return (x < t["q1"] - k * iqr) | (x > t["q3"] + k * iqr)
    return _apply(df, _widen(th, cols, by), ["q1", "q3"], cols, by, flag)


def outlier_zscore(df: DataFrame, cols: Sequence[str] | None = None, z: float = 3.0,
                   by: Sequence[str] = ()) -> DataFrame:
    """O2: null values with |x - mean| > z * std (sample std)."""
    cols = list(cols) if cols is not None else outlier_columns(df, by)
    wide = df.groupBy(*by).agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"_th_{i}_{n}") for i, c in enumerate(cols)
                                 for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
    return _apply(df, wide, ["mean", "std"], cols, by, lambda x, t: F.abs(x - t["mean"]) > z * t["std"])


def outlier_modz(df: DataFrame, cols: Sequence[str] | None = None, z: float = 3.5,
                 by: Sequence[str] = ()) -> DataFrame:
    """O3: null values with |x - median| > z * 1.4826 * MAD (MAD over non-null values, T11)."""
    cols = list(cols) if cols is not None else outlier_columns(df, by)
    by = list(by)
    med = _widen(quantile_table(df, by, {c: F.col(f"`{c}`") for c in cols}, [0.5], ["median"]), cols, by)
    x = attach(df.select(*by, *[F.col(f"`{c}`") for c in cols if c not in by]), med, by)
    dev = {c: F.abs(F.col(f"`{c}`") - F.col(f"_th_{i}_median")) for i, c in enumerate(cols)}
    mad = _widen(quantile_table(x, by, dev, [0.5], ["mad"]), cols, by)
    wide = join_on_keys(med, mad, by) if by else attach(med, mad, [])
    return _apply(df, wide, ["median", "mad"], cols, by, lambda x, t: F.abs(x - t["median"]) > z * (t["mad"] * 1.4826))


def preprocess(df: DataFrame, qc: Mapping[str, tuple[str, int]] | None = None, method: str | None = None,
               param: float | None = None, cols: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """QC filter first, then one outlier rule over the chosen columns."""
    if qc:
        df = qc_filter(df, qc)
    if method is None:
        return df
    m = method.lower().replace("-", "").replace(" ", "")
    if m == "iqr":
        return outlier_iqr(df, cols, 1.5 if param is None else param, by)
    if m in ("zscore", "z"):
        return outlier_zscore(df, cols, 3.0 if param is None else param, by)
    if m in ("modifiedzscore", "modz", "modifiedz"):
        return outlier_modz(df, cols, 3.5 if param is None else param, by)
    raise ValueError(f"unknown outlier method {method!r}")

"""Gap filling.

A null target takes the ALL prediction when every ALL feature is present,
else the TIME prediction; ``filled`` marks the rows that were null.  The
features are built for every target the models were trained with (T22).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from towerfill.plans.features import build_features
from towerfill.plans.modeling import TrainedModels, all_present
from towerfill.session import cut_lineage
from towerfill.timeline import Timeline


def route(df: DataFrame, target: str, all_features: Sequence[str], has_all: bool = True, lacking: str = "TIME") -> DataFrame:
    """M6 decision: ``filled`` (0/1) and ``route`` in {observed, ALL, TIME}.

    ``lacking`` says where a row goes that lacks some ALL features: to TIME as in the
    reference, or to "ALL" (a model that accepts missing features) if it has one at least."""
    if lacking not in ("TIME", "ALL"):
        raise ValueError(f"rows that lack features go to TIME or ALL, not {lacking!r}")
    use_all = F.lit(False)
    if has_all and lacking == "ALL":
        for c in all_features:
            use_all = use_all | all_present([c], df)
    elif has_all:
        use_all = all_present(all_features, df)
    r = F.when(F.col(target).isNotNull(), "observed").when(use_all, "ALL").otherwise("TIME")
    return df.withColumns({"filled": F.col(target).isNull().cast("int"), "route": r})


def predict(routed: DataFrame, tm: TrainedModels) -> DataFrame:
    """M5: ``_pred`` for the rows to be filled: ALL where routed to ALL, TIME where routed to TIME.

    Each model scores only its own rows; observed rows pass by both (null ``_pred``)."""
    keep = [F.col(f"`{c}`") for c in routed.columns]
    none = F.lit(None).cast("double").alias("_pred")
    out = routed.filter("route = 'observed'").select(*keep, none)
    out = out.unionByName(tm.model_time.transform(routed.filter("route = 'TIME'")).select(*keep, F.col("_pred_time").alias("_pred")))
    if tm.model_all is not None:
        out = out.unionByName(tm.model_all.transform(routed.filter("route = 'ALL'")).select(*keep, F.col("_pred_all").alias("_pred")))
    return out


def apply_fill(routed: DataFrame, target: str, keep_original: bool = False) -> DataFrame:
    value = F.coalesce(F.col(target), F.col("_pred"))
    if keep_original:
        routed = routed.withColumn(f"{target}_original", F.col(target))
    return routed.withColumn(target, value).drop("_pred")


def fill_with_features(feats: DataFrame, tm: TrainedModels, keep_original: bool = False, lacking: str = "TIME") -> DataFrame:
    """M5-M7 on a feature frame already built with ``tm.spec`` and ``tm.encoding``."""
    if lacking == "ALL" and not tm.accepts_missing:
        raise ValueError(f"{tm.model_type} models can't score rows that lack features")
    routed = route(feats, tm.target, tm.all_features, tm.model_all is not None, lacking)
    return apply_fill(predict(routed, tm), tm.target, keep_original)


def fill_gaps(df: DataFrame, tl: Timeline, tm: TrainedModels, keep_original: bool = False) -> DataFrame:
    """M7: features (with the stored encoding) -> predict -> route -> filled target."""
    feats, _ = build_features(df, tl, tm.spec, tm.encoding)
    return fill_with_features(cut_lineage(feats, "fill-features"), tm, keep_original)  # three branches read it


def fill_summary(filled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows filled and their share of all rows (percent)."""
    return filled.groupBy(*by).agg(F.sum("filled").alias("rows_filled"), (100 * F.avg("filled")).alias("pct_filled"))


def export_frame(filled: DataFrame, target: str, time_col: str = "datetime", keys: Sequence[str] = ()) -> DataFrame:
    """Datetime, target, filled."""
    return filled.select(*keys, time_col, target, "filled")


def overlay(filled: DataFrame, target: str, keys: Sequence[str]) -> DataFrame:
    """Original values beside the gap-filled values (only where ``filled`` = 1).
    ``filled`` must come from ``fill_gaps(..., keep_original=True)``."""
    return filled.select(*keys, F.col(f"{target}_original"),
                         F.when(F.col("filled") == 1, F.col(target)).alias(f"{target}_gapfilled"))


def write_export(filled: DataFrame, path: str, target: str, time_col: str = "datetime",
                 keys: Sequence[str] = (), tiebreak: Sequence[str] = ()) -> str:
    """K1: CSV in time order (per key), header once, in folder ``{path}/gapfilled_{target}_clean``: its parts in name order are the file."""
    from towerfill.sources.text import write_ordered_csv
    out = export_frame(filled, target, time_col, [*keys, *tiebreak])
    return write_ordered_csv(out, f"{path.rstrip('/')}/gapfilled_{target}_clean", [*keys, time_col, *tiebreak])

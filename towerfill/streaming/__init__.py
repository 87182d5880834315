"""Row-local cleaning on streaming DataFrames.

The reference has no streaming.  Its row-local steps (sentinel and NaN to null,
the QC-flag filter with fixed limits, calendar and meteorological features) are
pure column expressions, so they apply unchanged to a ``readStream`` frame.
Order-dependent steps (shift, rolling, gap runs) and the fitted thresholds of
the outlier rules are batch operations and are not offered here.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from towerfill.functions.calendar import add_time_features
from towerfill.functions.meteo import add_met_features, add_vpd
from towerfill.operators.encoding import apply_encoding
from towerfill.operators.quality import qc_filter
from towerfill.sources.layouts import nan_to_null, sentinel_to_null


def clean_stream(df: DataFrame, qc_limits: Mapping[str, tuple[str, int]] | None = None,
                 sentinels=(-9999,), time_col: str = "datetime", features: bool = True,
                 encoding: Mapping | None = None) -> DataFrame:
    """Apply S6, T1, P9 and (optionally) C1-C22 plus a stored C26 encoding to a stream."""
    x = nan_to_null(sentinel_to_null(df, sentinels))
    if qc_limits:
        x = qc_filter(x, qc_limits)
    if features:
        x = add_met_features(add_vpd(add_time_features(x, time_col)))
        if encoding:
            x = apply_encoding(x, encoding)
    return x

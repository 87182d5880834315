"""The feature frame (N1) and the two feature lists.

One window pass (a single exchange, see operators.sequence) adds the shift and rolling
features of every target to the source columns alone; then one projection adds calendar,
meteorological and encoded features, which no exchange has to carry.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from towerfill.functions.calendar import add_time_features
from towerfill.functions.constants import ROLLING_STATS, ROLLING_WINDOWS, SHIFT_PERIODS
from towerfill.functions.meteo import add_met_features, add_vpd
from towerfill.operators.encoding import apply_encoding, fit_encoding
from towerfill.operators.profile import base_features, is_numeric, time_features
from towerfill.operators.windows import add_window_features
from towerfill.timeline import Timeline, ensure_datetime

CATEGORICAL = ["wind_dir_cat", "stability_class"]


@dataclass
class FeatureSpec:
    targets: list[str]
    periods: list[int] = field(default_factory=lambda: list(SHIFT_PERIODS))
    direction: str = "backward"
    windows: list[int] = field(default_factory=lambda: list(ROLLING_WINDOWS))
    stats: list[str] = field(default_factory=lambda: list(ROLLING_STATS))
    # leak_free: rolling frames end at the previous row
    leak_free: bool = False

    def to_json(self) -> dict:
        return dict(targets=self.targets, periods=self.periods, direction=self.direction, windows=self.windows,
                    stats=self.stats, leak_free=self.leak_free)


def build_features(df: DataFrame, tl: Timeline, spec: FeatureSpec,
                   encoding: Mapping[str, Sequence[str]] | None = None) -> tuple[DataFrame, dict]:
    """Return the feature frame and the label encoding used (fitted here if not given)."""
    df = ensure_datetime(df, tl.time)
    timed = add_time_features(df, tl.time)
    late = not any(t in timed.columns and t not in df.columns for t in spec.targets)  # else a target is a calendar feature
    x = add_window_features(df if late else timed, tl, shift_cols=spec.targets, periods=spec.periods, direction=spec.direction,
                            rolling_cols=spec.targets, windows=spec.windows, stats=spec.stats,
                            rolling_end=-1 if spec.leak_free else 0)
    if late:
        shifted = [c for c in x.columns if c not in df.columns]
        x = add_time_features(x, tl.time).select(*[F.col(f"`{c}`") for c in [*timed.columns, *shifted]])
    x = add_met_features(add_vpd(x))
    if encoding is None:
        # The categories depend only on source columns: fit on the narrow projection.
        encoding = fit_encoding(add_met_features(df), CATEGORICAL)
    return apply_encoding(x, encoding), dict(encoding)


def feature_lists(source: DataFrame, features: DataFrame, targets: Sequence[str],
                  tl: Timeline) -> tuple[list[str], list[str]]:
    """Source columns without excluded names or targets, plus every added column; numeric only,
    sorted.  P8: the TIME features present.  Timeline keys are identifiers, not features."""
    keys = [*tl.series, *tl.tiebreak, tl.time]
    base = base_features(source, targets, keys)
    added = [c for c in features.columns if c not in source.columns]
    allf = sorted({c for c in base + added if c not in targets and is_numeric(features, c)})
    return allf, time_features(features)

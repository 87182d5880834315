"""Series key + total row order shared by every order-dependent operator.

The reference keeps one series per table and counts rows in file order.  Here a
table may hold many series; ``series`` names the key and ``time`` plus
``tiebreak`` must give a *total* order inside a series, so that row positions
(shift, rolling, gap runs) are deterministic when tasks are recomputed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Timeline:
    series: tuple[str, ...] = ()
    time: str = "datetime"
    tiebreak: tuple[str, ...] = ()
    # Rows per block when one series is split across tasks (see operators.sequence).
    block_rows: int = 1 << 16
    # Range partitions when rows are numbered (None: the session's shuffle partitions).
    ranges: int | None = None

    def __post_init__(self):
        object.__setattr__(self, "series", tuple(self.series))
        object.__setattr__(self, "tiebreak", tuple(self.tiebreak))

    @property
    def order(self) -> list[str]:
        return [self.time, *self.tiebreak]

    @property
    def keys(self) -> list[str]:
        return [*self.series, *self.order]

    def order_cols(self) -> list[Column]:
        return [F.col(c).asc_nulls_first() for c in self.order]

    def with_(self, **kw) -> "Timeline":
        d = dict(series=self.series, time=self.time, tiebreak=self.tiebreak,
                 block_rows=self.block_rows, ranges=self.ranges)
        d.update(kw)
        return Timeline(**d)


def ensure_datetime(df: DataFrame, time_col: str = "datetime") -> DataFrame:
    """Make sure a ``datetime`` column exists.

    Uses the time column if present, else composes ``date`` + ``time (UTC)``
    (``dd.MM.yyyy HH:mm:ss``), else fails like the reference does.
    """
    if time_col in df.columns:
        return df
    if "date" in df.columns and "time (UTC)" in df.columns:
        s = F.concat_ws(" ", F.col("date"), F.col("`time (UTC)`"))
        return df.withColumn(time_col, F.try_to_timestamp(s, F.lit("dd.MM.yyyy HH:mm:ss")).cast("timestamp_ntz"))
    raise ValueError("Could not infer or create 'datetime' column; the data needs datetime information")

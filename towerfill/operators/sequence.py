"""Row positions and row-count windows inside a series, without one task per series.

The reference counts rows in file order (``shift``, ``rolling``, its gap loop).
``Window.partitionBy(series)`` would put a whole series in one task, and one
series may hold a third of all rows.  So we split every series twice:

1. ``index_rows`` numbers rows exactly.  The rows are range-partitioned on the
   whole order key, which is unique, so the partitions are balanced whatever the
   time density, even when one timestamp repeats for a third of the rows; positions
   inside a partition come from a sort, are written once, and small per-partition
   offsets finish them.
2. ``neighbour_frame`` cuts the numbered rows into fixed-size row blocks and copies
   the few rows a block needs from its neighbours (``ahead`` rows after it,
   ``behind`` rows before it).  Any ``lead``/``lag``/``rowsBetween`` expression
   evaluated over ``(series, block)`` is then exact for the block's own rows.

There is this one path, whatever the size: nothing is counted first, and a short series
is one block. Spark chooses how many ranges there are (``Timeline.ranges`` overrides it).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from towerfill.session import cut_lineage
from towerfill.timeline import Timeline

INDEX = "_g"          # 0-based row position inside the series
HOME = "_home"        # row belongs to this block (not a halo copy)
BLOCK = "_blk"
_ONE_SERIES = "_series0"


def _series(df: DataFrame, tl: Timeline) -> tuple[DataFrame, list[str]]:
    if tl.series:
        return df, list(tl.series)
    return df.withColumn(_ONE_SERIES, F.lit(0)), [_ONE_SERIES]


def join_on_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join on ``keys``; the right side's key columns are dropped."""
    ren = {k: f"_r_{k}" for k in keys}
    r = right.withColumnsRenamed(ren)
    cond = [left[k].eqNullSafe(r[ren[k]]) for k in keys]
    out = left.join(r, cond, how)
    return out if how in ("left_semi", "left_anti", "semi", "anti") else out.drop(*ren.values())


def _literal(value, dt: T.DataType) -> Column:
    if value is None:
        return F.lit(None).cast(dt)
    if isinstance(dt, T.StructType):
        return F.struct(*[_literal(value[f.name], f.dataType).alias(f.name) for f in dt.fields])
    if isinstance(dt, T.ArrayType):
        return F.array(*[_literal(v, dt.elementType) for v in value]).cast(dt)
    return F.lit(value).cast(dt)


def attach(df: DataFrame, small: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Add the columns of a per-group table (one row per ``keys``) to every row.

    With keys the table has one row per group; AQE broadcasts it when it is small at
    run time and otherwise splits a hot group's partition (skew join).  Rows whose
    group has no row in ``small`` keep nulls (``how="left"``) or are dropped
    (``"inner"``).  With no keys the table has at most one row, a proven size: its
    values are read on the driver and added as literals, so no join is planned.
    """
    if keys:
        return join_on_keys(df, small, list(keys), how)
    rows = small.limit(2).collect()
    if len(rows) > 1:
        raise ValueError("attach without keys needs a table of at most one row")
    if not rows and how == "inner":
        return df.limit(0).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in small.schema.fields])
    row = rows[0] if rows else None
    return df.select("*", *[_literal(row[f.name] if row else None, f.dataType).alias(f.name)
                            for f in small.schema.fields])


def index_rows(df: DataFrame, tl: Timeline, count_nulls_of: Iterable[str] = ()) -> DataFrame:
    """Add ``_g``, the 0-based row position inside each series (order ``tl.order``).

    For each column ``c`` in ``count_nulls_of`` also add ``_nb_c``: the number
    of rows at or before this one (same series) where ``c`` is null.
    The order must be total (``tl.tiebreak``) for positions to be deterministic.

    The key (series, time, tiebreak) is unique, so Spark's sampled range bounds give
    partitions of about equal size whatever the time density (bursts, repeated
    stamps).  Inside a partition rows are sorted and numbered by
    ``monotonically_increasing_id`` (partition index in the high bits, position in the
    low bits); the result is written once, so positions are fixed for retries and
    later jobs.  Per (series, partition): row count, first position and null counts
    give exact offsets (a small table, windowed per series)."""
    nulls = list(count_nulls_of)
    x, s = _series(df, tl)
    keys = [F.col(k).asc_nulls_first() for k in [*s, *tl.order]]
    y = (x.repartitionByRange(*([tl.ranges] if tl.ranges else []), *keys).sortWithinPartitions(*keys)
          .withColumn("_mid", F.monotonically_increasing_id()))
    y = y.select("*", F.shiftright("_mid", 33).alias("_p"),
                 F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos")).drop("_mid")
    y = cut_lineage(y, "range-numbered")
    aggs = [F.count(F.lit(1)).alias("_pn"), F.min("_pos").alias("_p0")]
    aggs += [F.sum(F.col(c).isNull().cast("long")).alias(f"_pz_{i}") for i, c in enumerate(nulls)]
    cnt = y.groupBy(*s, "_p").agg(*aggs)
    before = Window.partitionBy(*s).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    off = cnt.select(*s, "_p", "_p0", F.coalesce(F.sum("_pn").over(before), F.lit(0)).alias("_poff"),
                     *[F.coalesce(F.sum(f"_pz_{i}").over(before), F.lit(0)).alias(f"_zoff_{i}")
                       for i in range(len(nulls))])
    # written first: its real size is known when the join is planned, so the rows are not shuffled for it
    y = join_on_keys(y, cut_lineage(off, "offsets"), [*s, "_p"])
    y = y.withColumn(INDEX, F.col("_poff") + F.col("_pos") - F.col("_p0"))
    if nulls:
        run = Window.partitionBy(*s, "_p").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
        for i, c in enumerate(nulls):
            y = y.withColumn(f"_nb_{c}", F.col(f"_zoff_{i}") + F.sum(F.col(c).isNull().cast("long")).over(run))
    drop = ["_p", "_pos", "_p0", "_poff", *[f"_zoff_{i}" for i in range(len(nulls))]]
    if not tl.series:
        drop.append(_ONE_SERIES)
    return y.drop(*drop)


def neighbour_frame(df: DataFrame, tl: Timeline, ahead: int, behind: int) -> tuple[DataFrame, Window]:
    """Rows plus halo copies, and the window spec to evaluate row-offset expressions.

    Evaluate expressions with the returned window, then keep ``filter(HOME)``
    rows and drop ``BLOCK``/``HOME``/``INDEX``.  ``ahead``/``behind`` are the
    largest row offsets after / before the current row that any expression reads.
    """
    ahead, behind = max(0, int(ahead)), max(0, int(behind))
    size = max(int(tl.block_rows), ahead, behind, 1)
    x = index_rows(df, tl)
    b = F.floor(F.col(INDEX) / F.lit(size)).cast("long")
    pos = F.col(INDEX) - b * F.lit(size)
    targets = F.array(b,
                      F.when((pos < ahead) & (b > 0), b - 1),
                      F.when(pos >= size - behind, b + 1) if behind > 0 else F.lit(None).cast("long"))
    x = (x.withColumn("_own", b)
          .withColumn(BLOCK, F.explode(F.filter(targets, lambda v: v.isNotNull())))
          .withColumn(HOME, F.col(BLOCK) == F.col("_own"))
          .drop("_own"))
    return x, Window.partitionBy(*tl.series, BLOCK).orderBy(INDEX)


def with_window_columns(df: DataFrame, tl: Timeline, ahead: int, behind: int,
                        build: "callable") -> DataFrame:
    """Add columns ``build(window) -> list[Column]`` evaluated exactly per series."""
    x, w = neighbour_frame(df, tl, ahead, behind)
    cols = build(w)
    return x.select(*[F.col(f"`{c}`") for c in df.columns], *cols, HOME).filter(F.col(HOME)).drop(HOME)

"""Registered queries over the ``tower`` view, each with its DuckDB oracle text.

Every query reads the driver's tables (through :mod:`towerfill.fixtures`) and runs
the library's operators on all rows.  Outputs are normalised for comparison:
integer columns become ``bigint`` and doubles are rounded to 6 places, and the
oracle SQL does the same.  The rounding is ``round(x + 1e-9, 6)`` on both sides:
means of two-decimal data often sit exactly on a rounding tie, and summation
order (partition count) would otherwise decide which way each engine rounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from towerfill.fixtures import TOWER, TOWER_VARIABLES, duck_tower_cte, tower

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
TIE_NUDGE = 1e-9


def nudge_rounding(sql: str) -> str:
    """Rewrite every ``round(e, 6)`` of an oracle text to ``round((e) + 1e-9, 6)``."""
    out, i, key = [], 0, "round("
    while True:
        j = sql.find(key, i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + len(key)])
            i = j + len(key)
            continue
        depth, k = 1, j + len(key)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = sql[j + len(key):k - 1]
        head, sep, digits = inner.rpartition(",")
        if sep and digits.strip() == "6":
            inner = f"({nudge_rounding(head)}) + 1e-9, 6"
        else:
            inner = nudge_rounding(inner)
        out.append(sql[i:j] + key + inner + ")")
        i = k

W = "WITH " + duck_tower_cte()


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return normalise(fn(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = nudge_rounding(sql)
        return fn
    return deco


def normalise(df: DataFrame) -> DataFrame:
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType))]
    cols = {n: F.col(f"`{n}`").cast("double") for n in numbers}
    if len(numbers) > 30:  # rounded by a lambda: as many single expressions make one method too long for the JVM to compile
        df = df.select("*", F.transform(F.array(*cols.values()), lambda x: F.round(x + TIE_NUDGE, 6)).alias("_rounded"))
        cols = {n: F.get("_rounded", F.lit(i)) for i, n in enumerate(numbers)}
    else:
        cols = {n: F.round(c + TIE_NUDGE, 6) for n, c in cols.items()}
    out = []
    for f in df.schema.fields:
        if f.name == "_rounded":
            continue
        c = cols.get(f.name, F.col(f"`{f.name}`"))
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


# --------------------------------------------------------------------------- gaps
from towerfill.operators import gaps as _gaps  # noqa: E402

_GAP_CTE = """, r AS (SELECT series_id, datetime, co2_flux IS NULL AS isn,
  row_number() OVER (PARTITION BY series_id ORDER BY datetime, event_id) - 1 AS g,
  row_number() OVER (PARTITION BY series_id, co2_flux IS NULL ORDER BY datetime, event_id) AS rn2
  FROM tower),
runs AS (SELECT series_id, 'co2_flux' AS variable, min(g) AS start_idx, count(*) AS length,
  min(datetime) AS start_time, max(datetime) AS end_time FROM r WHERE isn GROUP BY series_id, g - rn2)"""


@register("gap_runs", W + _GAP_CTE + " SELECT * FROM runs")
def q_gap_runs(spark, sf):
    """Runs of null co2_flux per series with start position and length."""
    return _gaps.gap_runs(tower(spark, sf), TOWER, "co2_flux")


#: Small blocks and ranges, so that every series of the test tables is split into many.
SPLIT = TOWER.with_(block_rows=256, ranges=50)


@register("gap_runs_split", W + _GAP_CTE + " SELECT * FROM runs")
def q_gap_runs_split(spark, sf):
    """W5, G9 on series split into 50 range partitions."""
    return _gaps.gap_runs(tower(spark, sf), SPLIT, "co2_flux")


@register("gap_summary", W + _GAP_CTE + """ SELECT series_id, variable, count(*) AS gap_count,
  round(avg(length), 6) AS mean_length, round(quantile_cont(length, 0.5), 6) AS median_length,
  max(length) AS max_length FROM runs GROUP BY series_id, variable""")
def q_gap_summary(spark, sf):
    """Gap count, mean, median and max length per series."""
    return _gaps.gap_summary(_gaps.gap_runs(tower(spark, sf), TOWER, "co2_flux"), TOWER)


@register("gap_histogram", W + _GAP_CTE + """ SELECT series_id, variable, length, count(*) AS gaps
  FROM runs GROUP BY series_id, variable, length""")
def q_gap_histogram(spark, sf):
    """Number of gaps per length."""
    return _gaps.gap_histogram(_gaps.gap_runs(tower(spark, sf), TOWER, "co2_flux"), TOWER)




# --------------------------------------------------------------------------- SQL mirrors
import math as _math  # noqa: E402

from towerfill.functions import calendar as _cal  # noqa: E402
from towerfill.functions import constants as K  # noqa: E402
from towerfill.functions import meteo as _met  # noqa: E402
from towerfill.operators import windows as _win  # noqa: E402


def fl(x: float) -> str:
    """A DuckDB double literal with the exact value of the Python float."""
    return "%.17e" % float(x)


def sql_div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN NULL ELSE ({a}) / ({b}) END)"


def sql_vpd(t="air_temperature", rh="relative_humidity") -> str:
    svp = f"({fl(K.SVP_A)} * exp({sql_div(f'{fl(K.SVP_B)} * {t}', f'{fl(K.SVP_C)} + {t}')}))"
    return f"({svp} - {svp} * {rh} / {fl(100.0)})"


def sql_vp_slope(t="air_temperature") -> str:
    e = f"exp({sql_div(f'{fl(17.27)} * {t}', f'{t} + {fl(237.3)}')})"
    return f"(4098 * ({fl(0.6108)} * {e}) / pow({t} + {fl(237.3)}, 2))"


def sql_inv_ra(u="wind_speed", height=2.0) -> str:
    return f"({fl(K.VON_KARMAN ** 2)} * {u} / {fl(_math.log(height / K.ROUGHNESS) ** 2)})"


def sql_pet(t="air_temperature", rh="relative_humidity", u="wind_speed",
            rad="downwelling_shortwave_flux_total") -> str:
    d, ira = sql_vp_slope(t), sql_inv_ra(u)
    num = f"({d} * ({rad} * {fl(K.W_TO_MJ_DAY)}) + {fl(K.RHO_AIR * K.CP_AIR)} * {sql_vpd(t, rh)} * {ira})"
    den = f"({d} + {fl(K.GAMMA_PSY)} * (1 + {K.SURFACE_RESISTANCE} * {ira}))"
    return f"({sql_div(num, den)} / {fl(K.LAMBDA_V)} * 1000 * 86400)"


def sql_diff_ratio(d="downwelling_shortwave_flux_diffuse", t="downwelling_shortwave_flux_total") -> str:
    return f"(CASE WHEN {t} > 0 THEN {sql_div(d, t)} END)"


def sql_stab_bin(x="obukhov_length") -> str:
    parts = [f"WHEN {x} IS NULL OR isnan({x}) OR {x} = '-inf'::DOUBLE THEN NULL"]
    parts += [f"WHEN {x} <= {e} THEN {i}" for i, e in enumerate(K.STABILITY_EDGES)]
    return "(CASE " + " ".join(parts) + f" ELSE {len(K.STABILITY_EDGES)} END)"


def sql_pick(values: list, idx: str) -> str:
    lits = ", ".join(f"'{v}'" if isinstance(v, str) else fl(v) for v in values)
    return f"([{lits}])[({idx}) + 1]"


def sql_wind_idx(d="wind_dir") -> str:
    x = f"((({d}) % 360.0E0 + 360.0E0) % 360.0E0)"
    return f"(CASE WHEN {d} IS NULL OR isnan({d}) THEN NULL WHEN {x} <= 22.5E0 THEN 0 ELSE CAST(ceil({x} / 22.5E0) AS INTEGER) - 1 END)"


def sql_time_cols(ts="datetime") -> dict[str, str]:
    c = {
        "hour": f"hour({ts})", "day": f"day({ts})", "month": f"month({ts})", "year": f"year({ts})",
        "dayofyear": f"dayofyear({ts})", "weekday": f"(isodow({ts}) - 1)", "quarter": f"quarter({ts})",
        "weekofyear": f"weekofyear({ts})",
    }
    c["is_weekend"] = f"CAST((isodow({ts}) - 1) >= 5 AS INTEGER)"
    for name, period in _cal.CYCLE_PERIODS:
        per = fl(period) if isinstance(period, float) else str(period)
        c[f"{name}_sin"] = f"sin({fl(_cal.TWO_PI)} * {c[name]} / {per})"
        c[f"{name}_cos"] = f"cos({fl(_cal.TWO_PI)} * {c[name]} / {per})"
    c["hour_decimal"] = f"(hour({ts}) + minute({ts}) / 60.0E0)"
    c["season"] = f"CAST(floor((month({ts}) % 12) / 3) AS INTEGER)"
    for i in range(4):
        c[f"season_{i}"] = f"CAST(floor((month({ts}) % 12) / 3) = {i} AS INTEGER)"
    h = f"hour({ts})"
    c["is_morning"] = f"CAST({h} >= 6 AND {h} < 12 AS INTEGER)"
    c["is_afternoon"] = f"CAST({h} >= 12 AND {h} < 18 AS INTEGER)"
    c["is_evening"] = f"CAST({h} >= 18 AND {h} < 22 AS INTEGER)"
    c["is_night"] = f"CAST({h} >= 22 OR {h} < 6 AS INTEGER)"
    return c


def sql_select(cols: dict[str, str], dbl: set[str] = frozenset()) -> str:
    """Render ``expr AS name``, rounding doubles and casting the rest of numbers to BIGINT."""
    out = []
    for name, e in cols.items():
        if name in dbl:
            out.append(f"round({e}, 6) AS {name}")
        else:
            out.append(f"CAST({e} AS BIGINT) AS {name}")
    return ", ".join(out)


_TC = sql_time_cols()
_BASE = ["hour", "day", "month", "year", "dayofyear", "weekday", "quarter", "weekofyear", "is_weekend"]
_MORE = ["hour_decimal", "season", "season_0", "season_1", "season_2", "season_3",
         "is_morning", "is_afternoon", "is_evening", "is_night"]
_CYC = [f"{n}_{f}" for n, _ in _cal.CYCLE_PERIODS for f in ("sin", "cos")]


@register("time_features", W + " SELECT event_id, series_id, datetime, "
          + sql_select({k: _TC[k] for k in _BASE + _MORE}, {"hour_decimal"}) + " FROM tower")
def q_time_features(spark, sf):
    """Calendar parts, weekend flag, decimal hour, season and its dummies, day parts."""
    df = _cal.add_time_features(tower(spark, sf).select("event_id", "series_id", "datetime"))
    return df.drop(*_CYC)


@register("cyclical_features", W + " SELECT event_id, " + sql_select({k: _TC[k] for k in _CYC}, set(_CYC))
          + " FROM tower")
def q_cyclical(spark, sf):
    """The twelve sin/cos columns."""
    df = _cal.add_time_features(tower(spark, sf).select("event_id", "datetime"))
    return df.select("event_id", *_CYC)


@register("month_lookup", W + " SELECT event_id, CAST(month(datetime) AS BIGINT) AS month, "
          + sql_pick(K.MONTH_NAMES, "month(datetime) - 1") + " AS month_name, CAST("
          + "([" + ", ".join(map(str, K.DAYS_IN_MONTH)) + "])[month(datetime)] AS BIGINT) AS days_in_month FROM tower")
def q_month_lookup(spark, sf):
    """Month name and days in month (February = 28)."""
    m = F.month("datetime")
    return tower(spark, sf).select("event_id", m.alias("month"), _cal.month_name(m).alias("month_name"),
                                   _cal.days_in_month(m).alias("days_in_month"))


_OVER = "OVER (PARTITION BY series_id ORDER BY datetime, event_id"


def _sql_shift(fn: str) -> str:
    cols = {f"co2_flux_lag_{k}": f"{fn}(co2_flux, {k}) {_OVER})" for k in K.SHIFT_PERIODS}
    return W + " SELECT event_id, series_id, datetime, " + sql_select(cols, set(cols)) + " FROM tower"


def _sql_roll(stats: list[str]) -> str:
    fns = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    cols = {f"co2_flux_rolling_{n}_{s}": f"{fns[s]}(co2_flux) {_OVER} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
            for n in K.ROLLING_WINDOWS for s in stats}
    return W + " SELECT event_id, series_id, datetime, " + sql_select(cols, set(cols)) + " FROM tower"


def _tower_keys(spark, sf):
    return tower(spark, sf).select("event_id", "series_id", "datetime", "co2_flux")


@register("shift_backward", _sql_shift("lead"))
def q_shift_backward(spark, sf):
    """W1 default direction: ``co2_flux_lag_k`` holds the value k rows later (reference semantics)."""
    return _win.add_shift_features(_tower_keys(spark, sf), TOWER, ["co2_flux"]).drop("co2_flux")


@register("shift_forward", _sql_shift("lag"))
def q_shift_forward(spark, sf):
    """W1 forward direction: the value k rows earlier."""
    return _win.add_shift_features(_tower_keys(spark, sf), TOWER, ["co2_flux"], direction="forward").drop("co2_flux")


@register("shift_backward_split", _sql_shift("lead"))
def q_shift_backward_split(spark, sf):
    """W1 on series split into blocks of 256 rows with copies of their neighbours' rows."""
    return _win.add_shift_features(_tower_keys(spark, sf), SPLIT, ["co2_flux"]).drop("co2_flux")


@register("rolling_split", _sql_roll(["std", "min", "max"]))
def q_rolling_split(spark, sf):
    """W3, W4 on series split into blocks of 256 rows."""
    return _win.add_rolling_features(_tower_keys(spark, sf), SPLIT, ["co2_flux"], stats=["std", "min", "max"]).drop("co2_flux")


@register("rolling_mean", _sql_roll(["mean"]))
def q_rolling_mean(spark, sf):
    """Trailing 3/6/12-row mean, at least one value."""
    return _win.add_rolling_features(_tower_keys(spark, sf), TOWER, ["co2_flux"], stats=["mean"]).drop("co2_flux")


@register("rolling_std", _sql_roll(["std"]))
def q_rolling_std(spark, sf):
    """Trailing sample std; one value gives null."""
    return _win.add_rolling_features(_tower_keys(spark, sf), TOWER, ["co2_flux"], stats=["std"]).drop("co2_flux")


@register("rolling_minmax", _sql_roll(["min", "max"]))
def q_rolling_minmax(spark, sf):
    """Trailing min and max."""
    return _win.add_rolling_features(_tower_keys(spark, sf), TOWER, ["co2_flux"],
                                     stats=["min", "max"]).drop("co2_flux")


@register("vpd", W + f" SELECT event_id, round({sql_vpd()}, 6) AS vpd FROM tower")
def q_vpd(spark, sf):
    """Vapour pressure deficit."""
    return _met.add_vpd(tower(spark, sf)).select("event_id", "vpd")


@register("potential_et", W + f" SELECT event_id, round({sql_vp_slope()}, 6) AS vp_slope, "
          f"round({sql_pet()}, 6) AS potential_et FROM tower")
def q_potential_et(spark, sf):
    """Slope of the vapour pressure curve and potential ET (shortwave total as radiation)."""
    t = F.col("air_temperature")
    return tower(spark, sf).select(
        "event_id", _met.vp_slope(t).alias("vp_slope"),
        _met.potential_et(t, F.col("relative_humidity"), F.col("wind_speed"),
                          F.col("downwelling_shortwave_flux_total")).alias("potential_et"))


@register("diff_ratio", W + f" SELECT event_id, round({sql_diff_ratio()}, 6) AS diff_ratio FROM tower")
def q_diff_ratio(spark, sf):
    """C17: diffuse / total shortwave where total > 0."""
    return _met.add_met_features(tower(spark, sf)).select("event_id", "diff_ratio")


@register("stability", W + f" SELECT event_id, {sql_pick(K.STABILITY_CLASSES, sql_stab_bin())} AS stability_class, "
          f"round({sql_pick([float(v) for v in K.STABILITY_INDEX], sql_stab_bin())}, 6) AS stability_index FROM tower")
def q_stability(spark, sf):
    """Obukhov-length stability class and index (right-closed bins)."""
    return _met.add_met_features(tower(spark, sf)).select("event_id", "stability_class", "stability_index")


@register("wind_sector", W + f" SELECT event_id, {sql_pick(K.WIND_SECTORS, sql_wind_idx())} AS wind_dir_cat, "
          + ", ".join(f"CAST(coalesce({sql_pick(K.WIND_SECTORS, sql_wind_idx())} = '{s}', false) AS BIGINT) AS wind_dir_{s}"
                      for s in K.WIND_SECTORS) + " FROM tower")
def q_wind_sector(spark, sf):
    """16-sector wind direction and its sixteen dummies."""
    return _met.add_met_features(tower(spark, sf)).select(
        "event_id", "wind_dir_cat", *[f"wind_dir_{s}" for s in K.WIND_SECTORS])


# --------------------------------------------------------------------------- profile & quality
from towerfill.fixtures import TOWER_VARIABLES  # noqa: E402
from towerfill.operators import profile as _prof  # noqa: E402
from towerfill.operators import quality as _qual  # noqa: E402

_INT_VARS = {"k", "co2_flux_qc"}
_OUT_COLS = [c for c in TOWER_VARIABLES if c != "co2_flux_qc"]  # numeric, not keys, not flags (P4)
_ALL_COLS = ["event_id", "series_id", "datetime", *TOWER_VARIABLES]


def _render_tower_cols(exprs: dict[str, str]) -> str:
    out = []
    for c in _ALL_COLS:
        e = exprs.get(c, c)
        if c in ("series_id", "datetime"):
            out.append(f"{e} AS {c}")
        elif c == "event_id" or c in _INT_VARS:
            out.append(f"CAST({e} AS BIGINT) AS {c}")
        else:
            out.append(f"round({e}, 6) AS {c}")
    return ", ".join(out)


@register("table_shape", W + f" SELECT series_id, count(*) AS n_rows, CAST({len(_ALL_COLS)} AS BIGINT) AS n_cols "
          "FROM tower GROUP BY series_id")
def q_table_shape(spark, sf):
    """G1: rows and columns per series."""
    return _prof.table_shape(tower(spark, sf), ["series_id"])


@register("missing_summary", W + ", m AS (" + " UNION ALL ".join(
    f"SELECT series_id, '{c}' AS variable, count(*) FILTER (WHERE {c} IS NULL) AS missing, count(*) AS n "
    f"FROM tower GROUP BY series_id" for c in TOWER_VARIABLES)
    + ") SELECT series_id, variable, missing, round_even(CAST(missing AS DOUBLE) / n * 100, 2) AS pct FROM m")
def q_missing_summary(spark, sf):
    """Null count and percent per variable and series, worst first."""
    return _prof.missing_summary(tower(spark, sf), TOWER_VARIABLES, ["series_id"])


@register("missing_matrix", W + " SELECT series_id, variable, bucket, round(avg(isn), 6) AS missing_frac FROM ("
          + " UNION ALL ".join(f"SELECT series_id, '{c}' AS variable, date_trunc('day', datetime) AS bucket, "
                               f"CAST({c} IS NULL AS INTEGER) AS isn FROM tower" for c in TOWER_VARIABLES)
          + ") GROUP BY series_id, variable, bucket")
def q_missing_matrix(spark, sf):
    """Share of nulls per variable and day (heatmap data)."""
    return _prof.missing_matrix(tower(spark, sf), TOWER_VARIABLES, "datetime", "day", ["series_id"])


@register("missing_records", W + ", rec AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY datetime, event_id) - 1 AS record FROM tower) "
          + " UNION ALL ".join(f"SELECT series_id, '{c}' AS variable, record FROM rec WHERE {c} IS NULL" for c in TOWER_VARIABLES))
def q_missing_records(spark, sf):
    """The missing matrix by record, packed to bitmaps per block and variable and unpacked again."""
    bits = _prof.missing_bitmaps(tower(spark, sf), TOWER_VARIABLES, TOWER)
    return _prof.missing_records(bits, TOWER_VARIABLES, ["series_id"])


@register("missing_records_window", W + ", rec AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY datetime, event_id) - 1 AS record FROM tower) "
          "SELECT series_id, 'co2_flux' AS variable, record FROM rec WHERE co2_flux IS NULL AND record BETWEEN 100 AND 299")
def q_missing_records_window(spark, sf):
    """A window of records drawn from the bitmaps."""
    bits = _prof.missing_bitmaps(tower(spark, sf), ["co2_flux"], SPLIT)
    return _prof.missing_records(bits, ["co2_flux"], ["series_id"], 100, 299)


@register("time_series", W + " SELECT series_id, datetime, event_id, round(co2_flux, 6) AS co2_flux FROM tower")
def q_time_series(spark, sf):
    """Datetime and variable in time order (whole series)."""
    return tower(spark, sf).select("series_id", "datetime", "event_id", "co2_flux").orderBy(*TOWER.keys)


@register("preview_head", W + " SELECT series_id, datetime, event_id, round(co2_flux, 6) AS co2_flux FROM tower "
          "QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY datetime, event_id) <= 50")
def q_preview_head(spark, sf):
    """L2: first 50 rows of each series (the preview is a top-k by design)."""
    t = tower(spark, sf).select("series_id", "datetime", "event_id", "co2_flux")
    return _prof.head(t, TOWER.order, 50, ["series_id"])


@register("diurnal_profile", W + " SELECT series_id, CAST(hour(datetime) AS BIGINT) AS hour, "
          "round(avg(co2_flux), 6) AS co2_flux_mean FROM tower GROUP BY series_id, hour(datetime)")
def q_diurnal(spark, sf):
    """Mean by hour of day."""
    return _prof.diurnal(tower(spark, sf), "co2_flux", "datetime", ["series_id"])


_BOX = ", ".join(f"round(quantile_cont(co2_flux, {p}), 6) AS {n}" for p, n in zip(_prof.BOX_PROBS, _prof.BOX_NAMES))


@register("monthly_box", W + ", big AS (SELECT series_id FROM tower GROUP BY series_id HAVING count(*) > 28) "
          f"SELECT series_id, CAST(month(datetime) AS BIGINT) AS month, {_BOX}, count(co2_flux) AS count "
          "FROM tower WHERE series_id IN (SELECT series_id FROM big) AND co2_flux IS NOT NULL "
          "GROUP BY series_id, month(datetime)")
def q_monthly_box(spark, sf):
    """Exact box statistics of co2_flux per month (series with more than 28 rows)."""
    return _prof.monthly_box(tower(spark, sf), "co2_flux", "datetime", ["series_id"])


@register("value_box", W + f" SELECT series_id, {_BOX}, count(co2_flux) AS count FROM tower "
          "WHERE co2_flux IS NOT NULL GROUP BY series_id")
def q_value_box(spark, sf):
    """G5 box marginal: exact min, quartiles, max of co2_flux per series."""
    return _prof.box_stats(tower(spark, sf), "co2_flux", ["series_id"])


def _sql_hist(col: str, src: str, bins: int = 30, by: str = "series_id") -> str:
    w = "((hi - lo) / " + str(bins) + ")"
    return (f", hx AS (SELECT {by}, {col} AS v FROM {src} WHERE {col} IS NOT NULL), "
            f"rg AS (SELECT {by}, min(v) AS lo, max(v) AS hi FROM hx GROUP BY {by}), "
            f"b AS (SELECT {by}, lo, hi, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor({sql_div('v - lo', w)}), {bins - 1}) END "
            f"AS BIGINT) AS bin FROM hx JOIN rg USING ({by})) "
            f"SELECT {by}, bin, round(lo + bin * {w}, 6) AS lower, "
            f"round(CASE WHEN bin = {bins - 1} THEN hi ELSE lo + (bin + 1) * {w} END, 6) AS upper, count(*) AS count "
            f"FROM b GROUP BY {by}, bin, lo, hi")


@register("value_histogram", W + _sql_hist("co2_flux", "tower"))
def q_value_histogram(spark, sf):
    """30 equal-width bins of co2_flux per series."""
    return _prof.value_histogram(tower(spark, sf), "co2_flux", 30, ["series_id"])


@register("qc_range", W + " SELECT series_id, 'co2_flux_qc' AS flag, CAST(min(co2_flux_qc) AS BIGINT) AS qc_min, "
          "CAST(max(co2_flux_qc) AS BIGINT) AS qc_max, least(CAST(max(co2_flux_qc) AS BIGINT), 1) AS default_limit "
          "FROM tower GROUP BY series_id")
def q_qc_range(spark, sf):
    """Flag range and default limit min(max, 1)."""
    return _prof.qc_range(tower(spark, sf), ["co2_flux_qc"], ["series_id"])


def _qc_limits(df):
    """Default limits from G8 over the whole table (one small row per flag column)."""
    pairs = _qual.default_qc_pairs(df)
    rng = {r.flag: r.default_limit for r in _prof.qc_range(df, sorted(set(pairs.values()))).collect()}
    return {flux: (flag, int(rng[flag])) for flux, flag in pairs.items()}


_QC_SQL = ", qc AS (SELECT * REPLACE (CASE WHEN co2_flux_qc > (SELECT least(max(co2_flux_qc), 1) FROM tower) " \
          "THEN NULL ELSE co2_flux END AS co2_flux) FROM tower)"


@register("qc_filter", W + _QC_SQL + " SELECT event_id, round(co2_flux, 6) AS co2_flux FROM qc")
def q_qc_filter(spark, sf):
    """co2_flux nulled where co2_flux_qc exceeds the default limit; null flags keep the value."""
    t = tower(spark, sf)
    return _qual.qc_filter(t, _qc_limits(t)).select("event_id", "co2_flux")


def _sql_outlier(method: str, src: str = "tower", param: float = 1.5) -> str:
    th, cond = [], {}
    if method == "iqr":
        for c in _OUT_COLS:
            th.append(f"quantile_cont({c}, 0.25) AS {c}_a, quantile_cont({c}, 0.75) AS {c}_b")
            cond[c] = f"({c} < {c}_a - {fl(param)} * ({c}_b - {c}_a) OR {c} > {c}_b + {fl(param)} * ({c}_b - {c}_a))"
        thsql = f", th AS (SELECT series_id, {', '.join(th)} FROM {src} GROUP BY series_id)"
    elif method == "z":
        for c in _OUT_COLS:
            th.append(f"avg({c}) AS {c}_a, stddev_samp({c}) AS {c}_b")
            cond[c] = f"(abs({c} - {c}_a) > {fl(param)} * {c}_b)"
        thsql = f", th AS (SELECT series_id, {', '.join(th)} FROM {src} GROUP BY series_id)"
    else:
        med = ", ".join(f"quantile_cont({c}, 0.5) AS {c}_a" for c in _OUT_COLS)
        mad = ", ".join(f"quantile_cont(abs(s.{c} - m.{c}_a), 0.5) * 1.4826E0 AS {c}_b" for c in _OUT_COLS)
        keep = ", ".join(f"m.{c}_a" for c in _OUT_COLS)
        for c in _OUT_COLS:
            cond[c] = f"(abs({c} - {c}_a) > {fl(param)} * {c}_b)"
        thsql = (f", med AS (SELECT series_id, {med} FROM {src} GROUP BY series_id), "
                 f"th AS (SELECT s.series_id, {keep}, {mad} FROM {src} s JOIN med m USING (series_id) "
                 f"GROUP BY s.series_id, {keep})")
    exprs = {c: f"CASE WHEN coalesce({cond[c]}, false) THEN NULL ELSE {c} END" for c in _OUT_COLS}
    return thsql + f" SELECT {_render_tower_cols(exprs)} FROM {src} JOIN th USING (series_id)"


@register("outlier_iqr", W + _sql_outlier("iqr", param=1.5))
def q_outlier_iqr(spark, sf):
    """O1: IQR rule (k = 1.5) per series on every numeric non-flag variable."""
    return _qual.outlier_iqr(tower(spark, sf), _OUT_COLS, 1.5, ["series_id"])


_SPIKY = ", spiky AS (SELECT * REPLACE (CASE WHEN event_id % 997 = 5 THEN 1.0E12 ELSE co2_flux END AS co2_flux) FROM tower)"


@register("outlier_iqr_spiky", W + _SPIKY + _sql_outlier("iqr", "spiky", 1.5))
def q_outlier_iqr_spiky(spark, sf):
    """O1: IQR rule on a co2_flux with spikes of 1e12 (derived from the events)."""
    spiky = F.when(F.expr("event_id % 997 = 5"), F.lit(1e12)).otherwise(F.col("co2_flux"))
    return _qual.outlier_iqr(tower(spark, sf).withColumn("co2_flux", spiky), _OUT_COLS, 1.5, ["series_id"])


@register("outlier_zscore", W + _sql_outlier("z", param=3.0))
def q_outlier_zscore(spark, sf):
    """O2: z-score rule (z = 3, sample std) per series."""
    return _qual.outlier_zscore(tower(spark, sf), _OUT_COLS, 3.0, ["series_id"])


@register("outlier_modz", W + _sql_outlier("modz", param=3.5))
def q_outlier_modz(spark, sf):
    """O3: modified z-score rule (3.5, MAD of non-null values) per series."""
    return _qual.outlier_modz(tower(spark, sf), _OUT_COLS, 3.5, ["series_id"])


@register("preprocess_chain", W + _QC_SQL + _sql_outlier("iqr", src="qc", param=1.5))
def q_preprocess_chain(spark, sf):
    """QC filter first, then the IQR rule."""
    t = tower(spark, sf)
    return _qual.preprocess(t, _qc_limits(t), "IQR", 1.5, _OUT_COLS, ["series_id"])


# --------------------------------------------------------------------------- flux analytics
from towerfill.operators import flux as _flux  # noqa: E402

_RN = ("((downwelling_shortwave_flux - upwelling_shortwave_flux) + "
       "(downwelling_longwave_flux - upwelling_longwave_flux))")
_EB_SQL = (f", eb AS (SELECT event_id, series_id, datetime, {_RN} AS Rnet, sensible_heat_flux, latent_heat_flux, "
           f"sensible_heat_flux + latent_heat_flux AS energy_balance, "
           f"{_RN} - (sensible_heat_flux + latent_heat_flux) AS residual FROM tower)")


def _eb(spark, sf):
    return _flux.energy_balance(tower(spark, sf), keep=["event_id", "series_id"])


@register("energy_balance", W + _EB_SQL + " SELECT event_id, series_id, datetime, round(Rnet, 6) AS Rnet, "
          "round(sensible_heat_flux, 6) AS sensible_heat_flux, round(latent_heat_flux, 6) AS latent_heat_flux, "
          "round(energy_balance, 6) AS energy_balance, round(residual, 6) AS residual FROM eb")
def q_energy_balance(spark, sf):
    """Net radiation, H, LE, H+LE and residual per row."""
    return _eb(spark, sf)


@register("ebc_regression", W + _EB_SQL + """, r AS (SELECT series_id, regr_count(energy_balance, Rnet) AS n_pairs,
  regr_slope(energy_balance, Rnet) AS sl, regr_intercept(energy_balance, Rnet) AS ic, regr_r2(energy_balance, Rnet) AS r2,
  min(CASE WHEN Rnet IS NOT NULL AND energy_balance IS NOT NULL THEN Rnet END) AS xmin,
  max(CASE WHEN Rnet IS NOT NULL AND energy_balance IS NOT NULL THEN Rnet END) AS xmax,
  min(CASE WHEN Rnet IS NOT NULL AND energy_balance IS NOT NULL THEN energy_balance END) AS ymin,
  max(CASE WHEN Rnet IS NOT NULL AND energy_balance IS NOT NULL THEN energy_balance END) AS ymax
  FROM eb GROUP BY series_id)
SELECT series_id, CAST(n_pairs AS BIGINT) AS n_pairs,
  round(CASE WHEN n_pairs > 10 THEN sl END, 6) AS slope, round(CASE WHEN n_pairs > 10 THEN ic END, 6) AS intercept,
  round(CASE WHEN n_pairs > 10 THEN r2 END, 6) AS r2, round(CASE WHEN n_pairs > 10 THEN xmin END, 6) AS x_min,
  round(CASE WHEN n_pairs > 10 THEN xmax END, 6) AS x_max,
  round(CASE WHEN n_pairs > 10 THEN sl * xmin + ic END, 6) AS line_y_min,
  round(CASE WHEN n_pairs > 10 THEN sl * xmax + ic END, 6) AS line_y_max,
  round(CASE WHEN n_pairs > 10 THEN least(xmin, ymin) END, 6) AS one_to_one_min,
  round(CASE WHEN n_pairs > 10 THEN greatest(xmax, ymax) END, 6) AS one_to_one_max FROM r""")
def q_ebc_regression(spark, sf):
    """Energy-balance closure regression per series (more than 10 pairs)."""
    return _flux.closure_regression(_eb(spark, sf), ["series_id"])


@register("ebc_ratio", W + _EB_SQL + f" SELECT series_id, round({sql_div('sum(energy_balance)', 'sum(Rnet)')}, 6) AS ebr, "
          "round(avg(residual), 6) AS mean_residual FROM eb GROUP BY series_id")
def q_ebc_ratio(spark, sf):
    """Energy balance ratio and mean residual per series."""
    return _flux.closure_ratio(_eb(spark, sf), ["series_id"])


def _sql_diurnal(col: str, src: str) -> str:
    return (f" SELECT series_id, CAST(hour(datetime) AS BIGINT) AS hour, round(avg({col}), 6) AS mean, "
            f"round(stddev_samp({col}), 6) AS std, round(avg({col}) + stddev_samp({col}), 6) AS upper, "
            f"round(avg({col}) - stddev_samp({col}), 6) AS lower FROM {src} GROUP BY series_id, hour(datetime)")


def _sql_monthly(col: str, src: str) -> str:
    return (f" SELECT series_id, CAST(month(datetime) AS BIGINT) AS month, round(avg({col}), 6) AS {col}, "
            f"{sql_pick(K.MONTH_NAMES, 'month(datetime) - 1')} AS month_name FROM {src} GROUP BY series_id, month(datetime)")


@register("carbon_diurnal", W + _sql_diurnal("co2_flux", "tower"))
def q_carbon_diurnal(spark, sf):
    """CO2 flux mean, std and band by hour."""
    return _flux.diurnal_stats(tower(spark, sf), "co2_flux", by=["series_id"])


@register("carbon_monthly", W + _sql_monthly("co2_flux", "tower"))
def q_carbon_monthly(spark, sf):
    """CO2 flux monthly mean with month name."""
    return _flux.monthly_mean(tower(spark, sf), "co2_flux", by=["series_id"])


_BUDGET_SQL = (", bud AS (SELECT series_id, month(datetime) AS month, avg(co2_flux) AS mean, count(co2_flux) AS count, "
               f"avg(co2_flux) * {fl(K.CARBON_FACTOR)} AS d, "
               f"([{', '.join(map(str, K.DAYS_IN_MONTH))}])[month(datetime)] AS days FROM tower GROUP BY series_id, month(datetime))")


@register("carbon_budget", W + _BUDGET_SQL + " SELECT series_id, CAST(month AS BIGINT) AS month, round(mean, 6) AS mean, "
          "count, round(d, 6) AS gC_m2_day, CAST(days AS BIGINT) AS days, round(d * days, 6) AS gC_m2_month, "
          f"{sql_pick(K.MONTH_NAMES, 'month - 1')} AS month_name FROM bud")
def q_carbon_budget(spark, sf):
    """Monthly carbon budget per series."""
    return _flux.carbon_budget(tower(spark, sf), by=["series_id"])


@register("carbon_annual", W + _BUDGET_SQL + " SELECT series_id, round(sum(d * days), 6) AS annual_gC_m2, "
          "CASE WHEN sum(d * days) < 0 THEN 'sink' ELSE 'source' END AS status FROM bud GROUP BY series_id")
def q_carbon_annual(spark, sf):
    """Annual budget and sink / source status per series."""
    return _flux.carbon_annual(_flux.carbon_budget(tower(spark, sf), by=["series_id"]), ["series_id"])


_BR_SQL = (", br AS (SELECT event_id, series_id, datetime, "
           f"{sql_div('sensible_heat_flux', 'latent_heat_flux')} AS bowen_ratio FROM tower), "
           "brf AS (SELECT * FROM br WHERE bowen_ratio > -10 AND bowen_ratio < 10)")


def _br(spark, sf):
    return _flux.bowen_series(tower(spark, sf), keep=["event_id", "series_id"])


@register("bowen_series", W + _BR_SQL + " SELECT event_id, series_id, datetime, round(bowen_ratio, 6) AS bowen_ratio FROM br")
def q_bowen_series(spark, sf):
    """Bowen ratio H / LE per row."""
    return _br(spark, sf)


@register("bowen_diurnal", W + _BR_SQL + _sql_diurnal("bowen_ratio", "brf"))
def q_bowen_diurnal(spark, sf):
    """Bowen ratio diurnal mean, std and band inside (-10, 10)."""
    return _flux.diurnal_stats(_flux.bowen_filtered(_br(spark, sf)), "bowen_ratio", by=["series_id"])


@register("bowen_monthly", W + _BR_SQL + _sql_monthly("bowen_ratio", "brf"))
def q_bowen_monthly(spark, sf):
    """Bowen ratio monthly mean inside (-10, 10)."""
    return _flux.monthly_mean(_flux.bowen_filtered(_br(spark, sf)), "bowen_ratio", by=["series_id"])


# --------------------------------------------------------------------------- artificial gaps
_BOWEN_MEAN = ("SELECT series_id, 'bowen' AS part, round(avg(b), 6) AS value FROM (SELECT series_id, CASE WHEN latent_heat_flux <> 0 THEN "
               "sensible_heat_flux / latent_heat_flux END AS b FROM tower) WHERE b > -10 AND b < 10 GROUP BY series_id")


@register("flux_report", W + _BUDGET_SQL + " SELECT series_id, 'carbon' AS part, round(sum(d * days), 6) AS value FROM bud GROUP BY series_id "
          "UNION ALL " + _BOWEN_MEAN)
def q_flux_report(spark, sf):
    """The flux report of a table without one radiation column: its energy part is skipped, the others stay."""
    parts = _flux.flux_report(tower(spark, sf).drop("upwelling_longwave_flux"), by=["series_id"])
    out = None
    for part, value in (("energy", "ebr"), ("carbon", "annual_gC_m2"), ("bowen", "mean_bowen")):
        if part in parts:
            t = parts[part].select("series_id", F.lit(part).alias("part"), F.col(value).alias("value"))
            out = t if out is None else out.unionByName(t)
    return out


@register("datetime_composed", W + " SELECT CAST(event_id AS BIGINT) AS event_id, date_trunc('second', datetime) AS datetime FROM tower")
def q_datetime_composed(spark, sf):
    """The datetime column composed from date and time (UTC)."""
    from towerfill.timeline import ensure_datetime
    t = tower(spark, sf).select("event_id", F.date_format("datetime", "dd.MM.yyyy").alias("date"),
                                F.date_format("datetime", "HH:mm:ss").alias("time (UTC)"))
    return ensure_datetime(t).select("event_id", "datetime")


@register("missing_summary_order", W + " SELECT *, row_number() OVER (ORDER BY series_id, missing DESC, variable) AS place FROM ("
          + " UNION ALL ".join(f"SELECT series_id, '{c}' AS variable, count(*) FILTER ({c} IS NULL) AS missing FROM tower GROUP BY series_id"
                               for c in TOWER_VARIABLES) + ")")
def q_missing_summary_order(spark, sf):
    """L1: the order in which the missing-value summary comes (worst first), as a number."""
    from pyspark.sql import Window
    s = _prof.missing_summary(tower(spark, sf), TOWER_VARIABLES, ["series_id"]).select("series_id", "variable", "missing")
    place = F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))  # a row per series and variable
    return s.withColumn("place", place)


@register("monthly_order", W + " SELECT series_id, CAST(month AS BIGINT) AS month, row_number() OVER (ORDER BY series_id, month) AS place FROM "
          "(SELECT DISTINCT series_id, month(datetime) AS month FROM tower)")
def q_monthly_order(spark, sf):
    """L3: the order in which monthly means come, by month number, as a number."""
    from pyspark.sql import Window
    m = _flux.monthly_mean(tower(spark, sf), "co2_flux", by=["series_id"]).select("series_id", "month")
    return m.withColumn("place", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))  # a row per series and month


@register("column_choices", W + " SELECT variable, n, CAST(variable NOT IN ('datetime', 'co2_flux_qc') AS BIGINT) AS plotted, "
          "CAST(variable <> 'datetime' AS BIGINT) AS target FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, count({c}) AS n FROM tower" for c in _ALL_COLS) + ")")
def q_column_choices(spark, sf):
    """Which columns can be plotted and which can be filled, with their values counted."""
    t = tower(spark, sf)
    plotted, targets = _prof.plot_columns(t), _prof.target_candidates(t)
    counts = t.agg(*[F.count(F.col(c)).alias(c) for c in t.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("n"), F.lit(int(c in plotted)).alias("plotted"),
                              F.lit(int(c in targets)).alias("target")) for c in t.columns])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


@register("outlier_default_columns", W + _sql_outlier("z", param=3.0))
def q_outlier_default_columns(spark, sf):
    """The z-score rule over the columns that the library chooses: numeric, no keys, no flags."""
    t = tower(spark, sf)
    return _qual.outlier_zscore(t, _prof.outlier_columns(t, TOWER.keys), 3.0, ["series_id"])


from towerfill.operators import masking as _mask  # noqa: E402

_U = "((CAST(CAST('0x' || substr(md5(concat('42:', event_id)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5E0) / 4503599627370496E0)"


def _sql_mask(weight: str | None) -> str:
    """Oracle: rank valid rows by key per series and null the first floor(n * 0.2)."""
    if weight is None:
        key, extra = _U, ""
    else:
        a = f"abs({weight})"
        extra = (f", ws AS (SELECT series_id, min({a}) AS lo, max({a}) AS hi FROM tower WHERE co2_flux IS NOT NULL "
                 "GROUP BY series_id)")
        w = f"(CASE WHEN hi = lo THEN 1.0E0 ELSE coalesce(({a} - lo) / (hi - lo) + 0.1E0, 0.1E0) END)"
        key = f"(-ln({_U}) / {w})"
    src = "tower JOIN ws USING (series_id)" if weight else "tower"
    return (W + extra + f", v AS (SELECT event_id, series_id, co2_flux, {key} AS key FROM {src}), "
            "r AS (SELECT event_id, row_number() OVER (PARTITION BY series_id ORDER BY key, event_id) AS rn, "
            "count(*) OVER (PARTITION BY series_id) AS n FROM v WHERE co2_flux IS NOT NULL) "
            "SELECT v.event_id, v.series_id, round(CASE WHEN r.rn <= floor(r.n * 0.2E0) THEN NULL ELSE v.co2_flux END, 6) "
            "AS co2_flux, CAST(coalesce(r.rn <= floor(r.n * 0.2E0), false) AS BIGINT) AS masked_co2_flux "
            "FROM v LEFT JOIN r USING (event_id)")


def _masked(spark, sf, mech, dep=None):
    t = tower(spark, sf).select("event_id", "series_id", "co2_flux", "air_temperature")
    m = _mask.artificial_gaps(t, ["co2_flux"], 0.2, mech, dep, 42, row_key=["event_id"], by=["series_id"])
    return m.select("event_id", "series_id", "co2_flux", "masked_co2_flux")


@register("mask_mcar", _sql_mask(None))
def q_mask_mcar(spark, sf):
    """M1, M4: null exactly floor(0.2 * n_valid) random co2_flux cells per series (seed 42)."""
    return _masked(spark, sf, "MCAR")


@register("mask_mar_fallback", _sql_mask(None))
def q_mask_mar_fallback(spark, sf):
    """M4: MAR without its driving column falls back to MCAR."""
    return _masked(spark, sf, "MAR", "no_such_column")


@register("mask_mar", _sql_mask("air_temperature"))
def q_mask_mar(spark, sf):
    """M2: weighted by min-max scaled |air_temperature| + 0.1 (Efraimidis-Spirakis keys)."""
    return _masked(spark, sf, "MAR", "air_temperature")


@register("mask_mnar", _sql_mask("co2_flux"))
def q_mask_mnar(spark, sf):
    """M3: weighted by the target's own scaled |value| + 0.1."""
    return _masked(spark, sf, "MNAR")


# --------------------------------------------------------------------------- features, routing, fill
from towerfill.operators.encoding import apply_encoding, fit_encoding  # noqa: E402
from towerfill.plans import evaluate as _eval  # noqa: E402
from towerfill.plans import fill as _fill  # noqa: E402
from towerfill.plans import modeling as _model  # noqa: E402
from towerfill.plans.features import FeatureSpec, build_features, feature_lists  # noqa: E402

_STAB_LABEL = sql_pick(K.STABILITY_CLASSES, sql_stab_bin())
_WIND_LABEL = sql_pick(K.WIND_SECTORS, sql_wind_idx())
_ENC_SQL = (f", enc_s AS (SELECT lab, row_number() OVER (ORDER BY lab) - 1 AS code FROM (SELECT DISTINCT "
            f"coalesce({_STAB_LABEL}, 'nan') AS lab FROM tower UNION SELECT 'nan')), "
            f"enc_w AS (SELECT lab, row_number() OVER (ORDER BY lab) - 1 AS code FROM (SELECT DISTINCT "
            f"coalesce({_WIND_LABEL}, 'nan') AS lab FROM tower UNION SELECT 'nan'))")


def _feature_sql_cols() -> dict[str, tuple[str, bool]]:
    """Every added feature of the frame: name -> (DuckDB expression, is_double)."""
    cols: dict[str, tuple[str, bool]] = {}
    for k, e in _TC.items():
        cols[k] = (e, k.endswith("_sin") or k.endswith("_cos") or k == "hour_decimal")
    for k in K.SHIFT_PERIODS:
        cols[f"co2_flux_lag_{k}"] = (f"lead(co2_flux, {k}) {_OVER})", True)
    fns = {"mean": "avg", "std": "stddev_samp"}
    for n in K.ROLLING_WINDOWS:
        for st in K.ROLLING_STATS:
            cols[f"co2_flux_rolling_{n}_{st}"] = (
                f"{fns[st]}(co2_flux) {_OVER} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)", True)
    cols["vpd"] = (sql_vpd(), True)
    cols["potential_et"] = (sql_pet(), True)
    cols["diff_ratio"] = (sql_diff_ratio(), True)
    cols["stability_class"] = ("(SELECT code FROM enc_s WHERE lab = coalesce(" + _STAB_LABEL + ", 'nan'))", False)
    cols["stability_index"] = (sql_pick([float(v) for v in K.STABILITY_INDEX], sql_stab_bin()), True)
    cols["wind_dir_cat"] = ("(SELECT code FROM enc_w WHERE lab = coalesce(" + _WIND_LABEL + ", 'nan'))", False)
    for sct in K.WIND_SECTORS:
        cols[f"wind_dir_{sct}"] = (f"CAST(coalesce({_WIND_LABEL} = '{sct}', false) AS INTEGER)", False)
    return cols


_FCOLS = _feature_sql_cols()
_BASE_FEATS = [c for c in TOWER_VARIABLES if c not in ("co2_flux", "co2_flux_qc")]
_ALL_FEATS = sorted(set(_BASE_FEATS) | set(_FCOLS))
_FF_SQL = (W + _ENC_SQL + ", ff AS (SELECT tower.*, "
           + ", ".join(f"{e} AS {n}" for n, (e, _) in _FCOLS.items()) + " FROM tower)")


def _ff_select() -> str:
    out = []
    for c in _ALL_COLS:
        out.append(c if c in ("series_id", "datetime") else
                   (f"CAST({c} AS BIGINT) AS {c}" if c == "event_id" or c in _INT_VARS else f"round({c}, 6) AS {c}"))
    for n, (_, dbl) in _FCOLS.items():
        out.append(f"round({n}, 6) AS {n}" if dbl else f"CAST({n} AS BIGINT) AS {n}")
    return ", ".join(out)


def _features(spark, sf, spec=None):
    src = tower(spark, sf)
    spec = spec or FeatureSpec(targets=["co2_flux"])
    feats, enc = build_features(src, TOWER, spec)
    allf, timef = feature_lists(src, feats, spec.targets, TOWER)
    return src, feats, enc, allf, timef, spec


@register("feature_frame", _FF_SQL + " SELECT " + _ff_select() + " FROM ff")
def q_feature_frame(spark, sf):
    """The full feature frame for target co2_flux (calendar, look-ahead shifts, rolling mean/std,
    VPD, potential ET, diffuse ratio, stability, wind sectors, label-encoded categories)."""
    return _features(spark, sf)[1]


@register("feature_frame_split", _FF_SQL + " SELECT " + _ff_select() + " FROM ff")
def q_feature_frame_split(spark, sf):
    """N1 on series split into blocks of 256 rows."""
    src = tower(spark, sf)
    return build_features(src, SPLIT, FeatureSpec(targets=["co2_flux"]))[0]


@register("label_encode", W + _ENC_SQL + f" SELECT event_id, CAST((SELECT code FROM enc_s WHERE lab = coalesce("
          f"{_STAB_LABEL}, 'nan')) AS BIGINT) AS stability_class, CAST((SELECT code FROM enc_w WHERE lab = "
          f"coalesce({_WIND_LABEL}, 'nan')) AS BIGINT) AS wind_dir_cat FROM tower")
def q_label_encode(spark, sf):
    """Sorted-vocabulary codes of stability_class and wind_dir_cat (nan reserved)."""
    from towerfill.functions.meteo import add_met_features
    m = add_met_features(tower(spark, sf)).select("event_id", "stability_class", "wind_dir_cat")
    return apply_encoding(m, fit_encoding(m, ["stability_class", "wind_dir_cat"]))


@register("label_dictionary", W + ", lab AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT coalesce(series_id || '-' "
          "|| CAST(nullif(event_id % 5000, 7) AS VARCHAR), 'nan') AS label FROM tower UNION SELECT 'nan')) "
          "SELECT CAST(event_id AS BIGINT) AS event_id, code AS tag FROM tower JOIN lab ON label = coalesce(series_id || '-' || CAST(nullif(event_id % 5000, 7) AS VARCHAR), 'nan')")
def q_label_dictionary(spark, sf):
    """Codes of a column of thousands of labels from the distributed dictionary."""
    from towerfill.operators.encoding import apply_dictionary, fit_dictionary
    tag = F.concat(F.col("series_id"), F.lit("-"), F.expr("nullif(event_id % 5000, 7)").cast("string"))
    t = tower(spark, sf).select("event_id", tag.alias("tag"))
    return apply_dictionary(t, fit_dictionary(t, ["tag"], ranges=7), ["tag"])


def _present_sql(cols) -> str:
    return " AND ".join(f"({c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE)))" for c in cols)


_ROUTE_SQL = (_FF_SQL + ", rt AS (SELECT event_id, series_id, CAST(co2_flux IS NULL AS BIGINT) AS filled, "
              f"CASE WHEN co2_flux IS NOT NULL THEN 'observed' WHEN {_present_sql(_ALL_FEATS)} THEN 'ALL' "
              "ELSE 'TIME' END AS route FROM ff)")


@register("fill_routing", _ROUTE_SQL + " SELECT * FROM rt")
def q_fill_routing(spark, sf):
    """Per row, observed / ALL (every ALL feature present) / TIME, and the filled flag."""
    _, feats, _, allf, _, _ = _features(spark, sf)
    return _fill.route(feats, "co2_flux", allf).select("event_id", "series_id", "filled", "route")


@register("fill_summary", _ROUTE_SQL + " SELECT series_id, sum(filled) AS rows_filled, "
          "round(100 * avg(filled), 6) AS pct_filled FROM rt GROUP BY series_id")
def q_fill_summary(spark, sf):
    """Rows the fill job fills and their percent, per series."""
    _, feats, _, allf, _, _ = _features(spark, sf)
    return _fill.fill_summary(_fill.route(feats, "co2_flux", allf), ["series_id"])


def trained(spark, sf, model_type="rf", params=None, feats=None):
    """The models for ``sf``: from this application's registry if they were saved there, else trained and saved."""
    import hashlib
    import json

    from towerfill.session import cut_lineage, scratch_path
    key = json.dumps([sf, model_type, sorted((params or {}).items())])
    root = scratch_path(spark, "models", spark.sparkContext.applicationId, hashlib.md5(key.encode()).hexdigest())
    registry = _model.ModelRegistry(spark, root)
    if not registry.exists(model_type, "co2_flux"):
        _, lazy, enc, allf, timef, spec = _features(spark, sf)
        feats = cut_lineage(lazy, "features") if feats is None else feats
        registry.save(_model.train_models(feats, "co2_flux", allf, timef, spec, enc, model_type, params, materialize=False))
    return registry.load(model_type, "co2_flux")


def _filled(spark, sf, model_type="rf", keep_original=False, params=None, lacking="TIME"):
    from towerfill.session import cut_lineage
    feats = cut_lineage(_features(spark, sf)[1], "features")
    return _fill.fill_with_features(feats, trained(spark, sf, model_type, params, feats=feats), keep_original, lacking)


_FILLED_SQL = (W + " SELECT event_id, series_id, round(co2_flux, 6) AS observed, CAST(co2_flux IS NULL AS BIGINT) AS filled, "
               "CAST(1 AS BIGINT) AS has_value FROM tower")


def _invariants(filled):
    """What holds whatever the models say: observed values are kept, gaps are marked, every row has a value."""
    return filled.select("event_id", "series_id", F.when(F.col("filled") == 0, F.col("co2_flux")).alias("observed"), "filled",
                         (F.col("co2_flux").isNotNull() & ~F.isnan("co2_flux")).alias("has_value"))


@register("fill_rf", _FILLED_SQL)
def q_fill_rf(spark, sf):
    """Random-forest ALL and TIME models (100 trees, depth 10), gaps filled; checked by invariants."""
    return _invariants(_filled(spark, sf, "rf"))


@register("fill_gbt", _FILLED_SQL)
def q_fill_gbt(spark, sf):
    """Gradient-boosted ALL and TIME models (100 rounds, depth 4, rate 0.05), gaps filled; checked by invariants."""
    return _invariants(_filled(spark, sf, "gbt"))


@register("fill_xgboost", _FILLED_SQL)
def q_fill_xgboost(spark, sf):
    """Regularised boosted trees (gamma, L1, L2, column sample; 10 rounds here) trained on rows with missing features too."""
    return _invariants(_filled(spark, sf, "xgboost", params={"trees": 10}))


@register("fill_forest_missing", _FILLED_SQL)
def q_fill_forest_missing(spark, sf):
    """A forest (10 trees, depth 6 here) that learns where missing features go; ALL fills every row that has any feature."""
    return _invariants(_filled(spark, sf, "forest", params={"trees": 10, "max_depth": 6}, lacking="ALL"))


#: Columns of few values for a tree that SQL can follow: one with missing values, two without.
_STUMP = {"s": "floor(sensible_heat_flux / 10)", "t": "floor(air_temperature)", "h": "CAST(hour(datetime) AS DOUBLE)"}
_STUMP_PARAMS = dict(trees=1, max_depth=1, eta=0.3, subsample=1.0, colsample=1.0, gamma=0.1, l1=0.1, l2=1.0, min_child_weight=3.0)


def _sql_worth(g: str, h: str) -> str:
    return f"(pow(greatest(abs({g}) - 0.1E0, 0), 2) / ({h} + 1))"


def _sql_stump() -> str:
    """Every cut of every column, with the missing rows on either side; the best by regularised gain; both leaves."""
    leaf = "-(CASE WHEN {g} < 0 THEN -1 ELSE 1 END) * greatest(abs({g}) - 0.1E0, 0) / ({h} + 1) * 0.3E0"
    return (W + ", st AS (SELECT event_id, datetime, co2_flux AS y, " + ", ".join(f"{e} AS {c}" for c, e in _STUMP.items()) + " FROM tower), "
            "x AS (" + " UNION ALL ".join(f"SELECT event_id, y, {i} AS f, CAST({c} AS DOUBLE) AS v FROM st" for i, c in enumerate(_STUMP)) + "), "
            "b AS (SELECT avg(y) AS base, count(y) AS n FROM st), "
            "lv AS (SELECT f, v, sum(base - y) AS g, count(*) AS h FROM x, b WHERE y IS NOT NULL GROUP BY f, v), "
            "c AS (SELECT f, v, sum(g) OVER w AS gl, sum(h) OVER w AS hl, lead(v) OVER (PARTITION BY f ORDER BY v) AS nv FROM lv WHERE v IS NOT NULL "
            "WINDOW w AS (PARTITION BY f ORDER BY v)), "
            "m AS (SELECT f, coalesce(sum(g) FILTER (v IS NULL), 0) AS gm, coalesce(sum(h) FILTER (v IS NULL), 0) AS hm, sum(g) AS g, sum(h) AS h FROM lv GROUP BY f), "
            "s AS (SELECT c.f, c.v, (c.v + coalesce(nv, c.v)) / 2 AS mid, nv IS NULL AS last, side, gl + side * gm AS gl, hl + side * hm AS hl, g, h "
            "FROM c JOIN m USING (f), (VALUES (0), (1)) k(side)), "
            f"k AS (SELECT *, {_sql_worth('gl', 'hl')} + {_sql_worth('(g - gl)', '(h - hl)')} - {_sql_worth('g', 'h')} AS gain FROM s WHERE hl >= 3 AND h - hl >= 3), "
            "best AS (SELECT * FROM k WHERE gain >= 0.1E0 ORDER BY gain DESC, f, v, side LIMIT 1), "
            "p AS (SELECT x.event_id, base + CASE WHEN CASE WHEN x.v IS NULL THEN side = 1 ELSE last OR x.v <= mid END THEN "
            + leaf.format(g="gl", h="hl") + " ELSE " + leaf.format(g="(g - gl)", h="(h - hl)") + " END AS prediction "
            "FROM x, best, b WHERE x.f = best.f) ")


@register("boosted_stump_missing", _sql_stump() + "SELECT event_id, round(prediction, 6) AS prediction, CAST(s IS NULL AS BIGINT) AS lacks FROM p JOIN st USING (event_id)")
def q_boosted_stump_missing(spark, sf):
    """One boosted split with gamma, L1, L2 and a learned side for missing values, against SQL that tries every cut."""
    from towerfill.plans.trees import fit_trees
    rows = tower(spark, sf).select("event_id", F.col("co2_flux").alias("y"), *[F.expr(e).alias(c) for c, e in _STUMP.items()])
    model = fit_trees(rows, "y", list(_STUMP), _STUMP_PARAMS)
    return model.transform(rows).select("event_id", "prediction", F.col("s").isNull().alias("lacks"))


@register("fill_routing_lacking", _FF_SQL + " SELECT event_id, CASE WHEN co2_flux IS NOT NULL THEN 'observed' WHEN sensible_heat_flux IS NOT NULL "
          "OR (vpd IS NOT NULL AND NOT isnan(vpd)) THEN 'ALL' ELSE 'TIME' END AS route FROM ff")
def q_fill_routing_lacking(spark, sf):
    """M6 for models that accept missing features: a row with any ALL feature goes to ALL."""
    return _fill.route(_features(spark, sf)[1], "co2_flux", ["sensible_heat_flux", "vpd"], lacking="ALL").select("event_id", "route")


@register("train_targets", W + " SELECT target, count(*) AS n FROM (SELECT unnest(['co2_flux', 'sensible_heat_flux']) AS target, event_id FROM tower) "
          "GROUP BY target")
def q_train_targets(spark, sf):
    """Models of two targets from one feature frame; each predicts every row from calendar features."""
    src = tower(spark, sf)
    targets = ["co2_flux", "sensible_heat_flux"]
    _, feats, enc, _, _, spec = _features(spark, sf, FeatureSpec(targets=targets))
    _, timef = feature_lists(src, feats, targets, TOWER)
    got = _model.train_targets(feats, targets, {t: (["air_temperature", "vpd"], timef) for t in targets}, spec, enc, "xgboost", {"trees": 2})
    out = None
    for t, tm in got.items():
        part = tm.model_time.transform(feats).filter(F.col("_pred_time").isNotNull()).groupBy().agg(F.count("*").alias("n")).select(F.lit(t).alias("target"), "n")
        out = part if out is None else out.unionByName(part)
    return out


# Fixed formulas in the models' place, so that SQL can follow a fill or an evaluation value by value.
_ALL_FORMULA = "air_temperature * 0.5E0 - latent_heat_flux * 0.25E0 + sensible_heat_flux"
_TIME_FORMULA = "CAST(event_id % 17 AS DOUBLE)"


def _formulas(spark, sf):
    """ALL and TIME models that compute the formulas (SQL transformers in pipelines), and the feature frame."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import SQLTransformer
    _, feats, enc, _, timef, spec = _features(spark, sf)
    m_all, m_time = (PipelineModel([SQLTransformer(statement=f"SELECT *, {f} AS {c} FROM __THIS__")])
                     for f, c in ((_ALL_FORMULA, "_pred_all"), (_TIME_FORMULA, "_pred_time")))
    allf = ["air_temperature", "latent_heat_flux", "sensible_heat_flux"]
    return _model.TrainedModels("formula", "co2_flux", allf, timef, m_all, m_time, spec, enc), feats


_FORMULA_FILL = (W + f", f AS (SELECT *, CAST(co2_flux IS NULL AS BIGINT) AS filled, round(coalesce(co2_flux, {_ALL_FORMULA}, "
                 f"{_TIME_FORMULA}), 6) AS value FROM tower)")


@register("fill_export", _FORMULA_FILL + " SELECT datetime, value AS co2_flux, filled FROM f")
def q_fill_export(spark, sf):
    """The export columns datetime, co2_flux, filled of a fill by fixed formulas."""
    tm, feats = _formulas(spark, sf)
    return _fill.export_frame(_fill.fill_with_features(feats, tm), "co2_flux")


@register("export_lines", _FORMULA_FILL + ", l AS (SELECT 1 AS body, series_id, datetime, event_id, series_id || ',' || CAST(event_id AS VARCHAR) || ',' || "
          "strftime(datetime, '%Y-%m-%d %H:%M:%S.%f') || ',' || CAST(filled AS VARCHAR) AS line FROM f UNION ALL SELECT 0, NULL, NULL, NULL, 'series_id,event_id,datetime,filled') "
          "SELECT row_number() OVER (ORDER BY body, series_id, datetime, event_id) AS place, line FROM l")
def q_export_lines(spark, sf):
    """K1: the export's lines by their place in the ordered parts: header once, then each series in time order."""
    import uuid

    from towerfill.session import scratch_path
    tm, feats = _formulas(spark, sf)
    out = _fill.fill_with_features(feats, tm).select("series_id", "event_id", "datetime", "filled")
    path = _text.write_ordered_csv(out, scratch_path(spark, "export", uuid.uuid4().hex), ["series_id", "datetime", "event_id"], ranges=9)
    from towerfill.sources.records import text_records
    lines = text_records(spark, path)
    part = F.regexp_extract("source", "part-([0-9]+)", 1).cast("long")
    count = lines.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.expr("sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), F.lit(0))
    return lines.withColumn("part", part).join(count.select("part", before.alias("before")), "part").select(
        (F.col("before") + F.col("line_no")).alias("place"), "line")


@register("fill_overlay", _FORMULA_FILL + " SELECT event_id, series_id, datetime, round(co2_flux, 6) AS co2_flux_original, "
          "CASE WHEN filled = 1 THEN value END AS co2_flux_gapfilled FROM f")
def q_fill_overlay(spark, sf):
    """Original co2_flux beside the values that a fill by fixed formulas produced."""
    tm, feats = _formulas(spark, sf)
    return _fill.overlay(_fill.fill_with_features(feats, tm, keep_original=True), "co2_flux", ["event_id", "series_id", "datetime"])


@register("model_reload", _FORMULA_FILL + " SELECT event_id, value AS co2_flux, filled FROM f")
def q_model_reload(spark, sf):
    """K3: models saved to the registry, found again by target and loaded, fill as the ones that were saved."""
    import uuid

    from towerfill.session import scratch_path
    tm, feats = _formulas(spark, sf)
    registry = _model.ModelRegistry(spark, scratch_path(spark, "models", uuid.uuid4().hex))
    registry.save(tm)
    back = registry.latest("co2_flux", ["rf", "formula"])
    return _fill.fill_with_features(feats, back).select("event_id", "co2_flux", "filled")


def _report(spark, sf, tm, mechanism="MCAR", dep=None):
    return _eval.evaluate(tower(spark, sf), TOWER, tm, mechanism, 0.2, dep, 42, row_key=["event_id"])


def _sql_report(weight: str | None = None) -> str:
    """Oracle: the hidden cells of the complete cases with the formula's value (all features are there)."""
    complete = "(" + " + ".join(TOWER_VARIABLES) + ") IS NOT NULL"
    text = W + f", c AS (SELECT * FROM tower WHERE {complete})"
    key, src = _U, "c"
    if weight:
        a = f"abs({weight})"
        text += f", ws AS (SELECT series_id, min({a}) AS lo, max({a}) AS hi FROM c GROUP BY series_id)"
        key = f"(-ln({_U}) / (CASE WHEN hi = lo THEN 1.0E0 ELSE ({a} - lo) / (hi - lo) + 0.1E0 END))"
        src = "c JOIN ws USING (series_id)"
    return (text + f", v AS (SELECT *, {key} AS key FROM {src}), rk AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY key, "
            "event_id) AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM v), "
            f"rep AS (SELECT event_id, co2_flux AS original, {_ALL_FORMULA} AS filled, co2_flux - ({_ALL_FORMULA}) AS residual "
            "FROM rk WHERE rn <= floor(n * 0.2E0))")


@register("evaluate_rf", _sql_report() + " SELECT event_id, round(original, 6) AS original, CAST(1 AS BIGINT) AS has_value, CAST(1 AS BIGINT) AS residual_fits, "
          "CAST(1 AS BIGINT) AS routed FROM rep")
def q_evaluate_rf(spark, sf):
    """Complete cases -> features -> 20 % MCAR gaps -> random-forest fill; checked by invariants."""
    r = _report(spark, sf, trained(spark, sf, "rf"))
    return r.select("event_id", "original", F.col("filled").isNotNull().alias("has_value"),
                    (F.abs(F.col("original") - F.col("filled") - F.col("residual")) < 1e-9).alias("residual_fits"),
                    F.col("route").isin("ALL", "TIME").alias("routed"))


@register("eval_metrics", _sql_report() + " SELECT count(*) AS n, round(avg(abs(residual)), 6) AS mae, round(sqrt(avg(residual * residual)), 6) "
          "AS rmse, round(1 - sum(residual * residual) / (count(*) * var_pop(original)), 6) AS r2, "
          "round(regr_slope(filled, original), 6) AS slope FROM rep")
def q_eval_metrics(spark, sf):
    """MAE, RMSE, R^2 and slope of a fill by fixed formulas on the hidden cells."""
    return _eval.evaluation_metrics(_report(spark, sf, _formulas(spark, sf)[0]))


@register("residual_histogram", _sql_report() + ", g AS (SELECT min(residual) AS lo, max(residual) AS hi FROM rep), "
          "b AS (SELECT CASE WHEN hi = lo THEN 0 ELSE least(CAST(floor((residual - lo) / ((hi - lo) / 30)) AS BIGINT), 29) END AS bin, lo, hi "
          "FROM rep, g) SELECT bin, round(lo + bin * ((hi - lo) / 30), 6) AS lower, round(CASE WHEN bin = 29 THEN hi ELSE lo + (bin + 1) * "
          "((hi - lo) / 30) END, 6) AS upper, count(*) AS count FROM b GROUP BY bin, lo, hi")
def q_residual_histogram(spark, sf):
    """Residuals of an evaluation by fixed formulas in 30 bins."""
    from towerfill.operators.metrics import residual_histogram
    return residual_histogram(_report(spark, sf, _formulas(spark, sf)[0]), "residual", 30)


@register("eval_pairs", _sql_report() + " SELECT count(*) AS n, round(least(min(original), min(filled)), 6) AS min_val, "
          "round(greatest(max(original), max(filled)), 6) AS max_val FROM rep")
def q_eval_pairs(spark, sf):
    """Range of observed and predicted values (1:1 line ends) of an evaluation by fixed formulas."""
    from towerfill.operators.metrics import pair_range
    return pair_range(_report(spark, sf, _formulas(spark, sf)[0]), "original", "filled")


@register("eval_report", _sql_report("air_temperature") + " SELECT event_id, round(original, 6) AS original, round(filled, 6) AS filled, "
          "round(residual, 6) AS residual, 'MAR' AS mechanism, 0.2E0 AS nan_percentage, 'co2_flux' AS target_variable, "
          "'air_temperature' AS dependency_col FROM rep")
def q_eval_report(spark, sf):
    """K2: evaluation report rows with run settings (MAR driven by air_temperature), filled by fixed formulas."""
    return _report(spark, sf, _formulas(spark, sf)[0], "MAR", "air_temperature").drop("route")


# --------------------------------------------------------------------------- sources and layouts
from towerfill.sources import archive as _arch  # noqa: E402
from towerfill.sources import layouts as _lay  # noqa: E402
from towerfill.sources import text as _text  # noqa: E402


def _stamp(fmt: str, plus: str | None = None):
    c = F.col("datetime") if plus is None else F.col("datetime") + F.expr(f"INTERVAL {plus}")
    return F.date_format(c, fmt)


def _sentinel(c: str):
    return F.coalesce(F.col(c), F.lit(-9999.0)).alias(c)


def _layout_out(df, label, cols):
    return df.select("datetime", *cols, F.lit(label).alias("layout"))


def _sql_layout(trunc: str, label: str, cols: list[str], renames: dict[str, str] | None = None) -> str:
    renames = renames or {}
    sel = []
    for c in cols:
        src = renames.get(c, c)
        sel.append(c if c == "series_id" else (f"CAST({src} AS BIGINT) AS {c}" if c == "event_id"
                                               else f"round({src}, 6) AS {c}"))
    return (W + f" SELECT date_trunc('{trunc}', datetime) AS datetime, {', '.join(sel)}, '{label}' AS layout FROM tower")


_LCOLS = ["event_id", "series_id", "co2_flux", "sensible_heat_flux"]


@register("layout_fluxnet", _sql_layout("minute", "FLUXNET", _LCOLS))
def q_layout_fluxnet(spark, sf):
    """FLUXNET half-hourly layout (yyyyMMddHHmm stamps, -9999 missing) parsed back."""
    t = tower(spark, sf)
    stand = t.select(_stamp("yyyyMMddHHmm").cast("long").alias("TIMESTAMP_START"),
                     _stamp("yyyyMMddHHmm", "30 MINUTES").cast("long").alias("TIMESTAMP_END"),
                     "event_id", "series_id", _sentinel("co2_flux"), _sentinel("sensible_heat_flux"))
    df, label = _lay.detect_layout(stand)
    return _layout_out(df, label, _LCOLS)


@register("layout_aggregated", _sql_layout("hour", "FLUXNET", ["event_id", "series_id", "NEE_VUT_REF"],
                                           {"NEE_VUT_REF": "co2_flux"}))
def q_layout_aggregated(spark, sf):
    """FLUXNET aggregated layout (TIMESTAMP yyyyMMddHH, NEE_VUT_REF) parsed per row by stamp length."""
    t = tower(spark, sf)
    stand = t.select(_stamp("yyyyMMddHH").cast("long").alias("TIMESTAMP"), "event_id", "series_id",
                     F.coalesce("co2_flux", F.lit(-9999.0)).alias("NEE_VUT_REF"))
    df, label = _lay.detect_layout(stand)
    return _layout_out(df, label, ["event_id", "series_id", "NEE_VUT_REF"])


@register("layout_icos", _sql_layout("second", "ICOS", _LCOLS))
def q_layout_icos(spark, sf):
    """ICOS layout (TIMESTAMP, TIMESTAMP_END text stamps); both stamps dropped."""
    t = tower(spark, sf)
    stand = t.select(_stamp("yyyy-MM-dd HH:mm:ss").alias("TIMESTAMP"),
                     _stamp("yyyy-MM-dd HH:mm:ss", "30 MINUTES").alias("TIMESTAMP_END"),
                     "event_id", "series_id", _sentinel("co2_flux"), _sentinel("sensible_heat_flux"))
    df, label = _lay.detect_layout(stand)
    return _layout_out(df, label, _LCOLS)


@register("layout_ameriflux", _sql_layout("minute", "AMERIFLUX", ["event_id", "series_id", "FC"], {"FC": "co2_flux"}))
def q_layout_ameriflux(spark, sf):
    """S4d: AmeriFlux layout (TIMESTAMP_START, FC); -9999 becomes null (T5)."""
    t = tower(spark, sf)
    stand = t.select(_stamp("yyyyMMddHHmm").cast("long").alias("TIMESTAMP_START"), "event_id", "series_id",
                     F.coalesce("co2_flux", F.lit(-9999.0)).alias("FC"))
    df, label = _lay.detect_layout(stand)
    return _layout_out(df, label, ["event_id", "series_id", "FC"])


_EC_OUT = ["event_id", "series_id", "co2_flux", "sensible_heat_flux", "latent_heat_flux", "air_temperature", "wind_dir"]


@register("layout_ec_tower", _sql_layout("second", "EC Tower", _EC_OUT))
def q_layout_ec_tower(spark, sf):
    """S4e, S5: EC-tower layout (date dd.MM.yyyy + time (UTC), long variable names) renamed to short names;
    the two air-temperature sources are merged in map order."""
    t = tower(spark, sf)
    stand = t.select(
        _stamp("dd.MM.yyyy").alias("date"), _stamp("HH:mm:ss").alias("time (UTC)"), "event_id", "series_id",
        F.col("co2_flux").alias(K.EC_TOWER_CO2),
        F.col("sensible_heat_flux").alias("upward sensible heat flux in air (W m-2) (H)"),
        F.col("latent_heat_flux").alias("upward latent heat flux in air (W m-2) (LE)"),
        F.when(F.col("k") % 2 == 0, F.lit(None)).otherwise(F.col("air_temperature"))
         .alias("air temperature (degree_C) (T_40m_Avg)"),
        F.col("air_temperature").alias("air temperature (degree_C) (T_1000cm_Avg)"),
        F.col("wind_dir").alias("wind from direction (degree) (wind_dir)"))
    df, label = _lay.detect_layout(stand)
    return _layout_out(df, label, _EC_OUT)


@register("layout_general", _sql_layout("second", "GENERAL TIME SERIES", _LCOLS))
def q_layout_general(spark, sf):
    """S4f: general series with a text ``timestamp`` column (first name in the priority list)."""
    t = tower(spark, sf)
    stand = t.select(_stamp("yyyy-MM-dd HH:mm:ss").alias("timestamp"), *_LCOLS)
    df, label = _lay.detect_layout(stand)
    return _layout_out(df, label, _LCOLS)


@register("sentinel_null", W + " SELECT event_id, round(co2_flux, 6) AS co2_flux, "
          "round(sensible_heat_flux, 6) AS sensible_heat_flux, CAST(k AS BIGINT) AS k FROM tower")
def q_sentinel_null(spark, sf):
    """Exact -9999 and NaN become null in every numeric column."""
    t = tower(spark, sf)
    stand = t.select("event_id", _sentinel("co2_flux"),
                     F.when(F.col("sensible_heat_flux").isNull(), F.lit(float("nan")))
                      .otherwise(F.col("sensible_heat_flux")).alias("sensible_heat_flux"), "k")
    return _lay.nan_to_null(_lay.sentinel_to_null(stand))


_RT_COLS = ["event_id", "series_id", "co2_flux", "co2_flux_qc"]


@register("csv_roundtrip", W + " SELECT datetime, CAST(event_id AS BIGINT) AS event_id, series_id, "
          "round(co2_flux, 6) AS co2_flux, CAST(co2_flux_qc AS BIGINT) AS co2_flux_qc, "
          "'GENERAL TIME SERIES' AS layout FROM tower")
def q_csv_roundtrip(spark, sf):
    """S1, S7, K1-style sink: tower rows written as header CSV by the executors, read back as strings,
    missing tokens nulled, types inferred, time column detected and parsed."""
    import uuid

    from towerfill.session import scratch_path
    path = scratch_path(spark, "roundtrip", uuid.uuid4().hex)
    _text.write_csv(tower(spark, sf).select("datetime", *_RT_COLS), path)
    df, label = _lay.detect_layout(_text.read_csv(spark, path))
    return _layout_out(df, label, _RT_COLS)


def _write_zips(spark, df, folder, quoted=False, raw=False):
    """Stand-in input for S2/S3: each partition becomes one ZIP holding one CSV member that starts with two
    metadata lines, streamed batch by batch into the shared folder."""
    from towerfill.session import make_folder
    uri = make_folder(spark, folder)

    def write(batches):
        import csv as _csv
        import uuid as _uuid
        import zipfile as _zf

        import pandas as _pd
        from pyarrow import fs as _fs
        files, path = _fs.FileSystem.from_uri(uri)
        name, rows = f"part-{_uuid.uuid4().hex}.zip", 0
        with files.open_output_stream(f"{path}/{name}") as out, _zf.ZipFile(out, "w", _zf.ZIP_DEFLATED) as z:
            z.writestr("README.md", "not a table")
            with z.open("data/tower.csv", "w", force_zip64=True) as member:
                member.write(b"site: tower\nexported by: towerfill\n")
                for pdf in batches:
                    if raw:  # lines as they are
                        member.write(("" if rows else df_columns[0] + "\n").encode() + "".join(x + "\n" for x in pdf.iloc[:, 0]).encode())
                        rows += len(pdf)
                        continue
                    member.write(pdf.to_csv(index=False, header=not rows, date_format="%Y-%m-%d %H:%M:%S.%f",
                                            quoting=_csv.QUOTE_NONNUMERIC if quoted else _csv.QUOTE_MINIMAL).encode())
                    rows += len(pdf)
                if not rows:  # the header as the other archives write it
                    member.write((df_columns[0] + "\n" if raw else _pd.DataFrame(columns=df_columns).to_csv(
                        index=False, quoting=_csv.QUOTE_NONNUMERIC if quoted else _csv.QUOTE_MINIMAL)).encode())
        yield _pd.DataFrame({"file": [name]})

    df_columns = list(df.columns)
    return df.mapInPandas(write, "file string").collect()


@register("zip_ingest", W + " SELECT datetime, CAST(event_id AS BIGINT) AS event_id, series_id, "
          "round(co2_flux, 6) AS co2_flux, CAST(co2_flux_qc AS BIGINT) AS co2_flux_qc, "
          "'GENERAL TIME SERIES' AS layout FROM tower")
def q_zip_ingest(spark, sf):
    """ZIP archives scanned per task, CSV members found, two metadata lines skipped (auto),
    parsed with from_csv, types inferred, layout detected."""
    import uuid

    from towerfill.session import scratch_path
    folder = scratch_path(spark, "zips", uuid.uuid4().hex)
    _write_zips(spark, tower(spark, sf).select("datetime", *_RT_COLS), folder)
    df, label = _lay.detect_layout(_arch.read_table(spark, folder, skip_rows="auto", glob="*.zip"))
    return _layout_out(df, label, _RT_COLS)


@register("zip_quoted_skip", W + " SELECT datetime, CAST(event_id AS BIGINT) AS event_id, 'x, ' || series_id || chr(10) || 'y' "
          "AS note, round(co2_flux, 6) AS co2_flux FROM tower")
def q_zip_quoted_skip(spark, sf):
    """ZIP members with metadata lines and quoted commas and line breaks lose no row and no header."""
    import uuid

    from towerfill.session import scratch_path
    folder = scratch_path(spark, "zips", uuid.uuid4().hex)
    note = F.concat(F.lit("x, "), F.col("series_id"), F.lit("\ny"))
    _write_zips(spark, tower(spark, sf).select("datetime", "event_id", note.alias("note"), "co2_flux"), folder, quoted=True)
    df, _ = _lay.detect_layout(_arch.read_table(spark, folder, skip_rows="auto", glob="*.zip"))
    return df.select("datetime", "event_id", "note", "co2_flux")


@register("zip_stray_quotes", W + " SELECT CAST(event_id AS BIGINT) AS event_id, CASE CAST(event_id % 3 AS INT) WHEN 0 THEN '5\" pipe' "
          "WHEN 1 THEN 'x, \"y\"' || chr(10) || 'z' ELSE 'say ' || CAST(k AS VARCHAR) END AS note, CAST(k AS BIGINT) AS k FROM tower")
def q_zip_stray_quotes(spark, sf):
    """A quote inside a plain value is a character, one at its start opens a value that may span lines; no row is lost."""
    import uuid

    from towerfill.session import scratch_path
    folder = scratch_path(spark, "zips", uuid.uuid4().hex)
    _write_zips(spark, _noted(tower(spark, sf)), folder, raw=True)
    return _arch.read_table(spark, folder, skip_rows="auto", glob="*.zip").select("event_id", "note", "k")


def _noted(t):
    """Lines ``event_id,note,k`` as a careless writer leaves them: stray quotes, and quoted values with line breaks."""
    note = (F.when(F.expr("event_id % 3 = 0"), F.lit('5" pipe')).when(F.expr("event_id % 3 = 1"), F.lit('"x, ""y""\nz"'))
            .otherwise(F.concat(F.lit("say "), F.col("k").cast("string"))))
    return t.select(F.concat_ws(",", F.col("event_id").cast("string"), note, F.col("k").cast("string")).alias("event_id,note,k"))


@register("csv_quote_scan", W + " SELECT CAST(event_id AS BIGINT) AS event_id, CASE CAST(event_id % 3 AS INT) WHEN 0 THEN '5\" pipe' "
          "WHEN 1 THEN 'x, \"y\"' || chr(10) || 'z' ELSE 'say ' || CAST(k AS VARCHAR) END AS note, CAST(k AS BIGINT) AS k FROM tower")
def q_csv_quote_scan(spark, sf):
    """Plain files with quoted line breaks and stray quotes, split anywhere, put together by the scan over quote states."""
    import uuid

    from towerfill.session import scratch_path
    path = scratch_path(spark, "quotes", uuid.uuid4().hex)
    lines = _noted(tower(spark, sf)).select(F.col("`event_id,note,k`").alias("value"))

    def headed(batches):  # each part file begins with the header
        import pandas as _pd
        yield _pd.DataFrame({"value": ["event_id,note,k"]})
        yield from batches

    lines.mapInPandas(headed, "value string").write.text(path)
    return _arch.read_table(spark, path)


@register("csv_column_order", W + " SELECT CAST(event_id AS BIGINT) AS event_id, CAST(k AS BIGINT) AS k, round(wind_speed, 6) AS wind_speed, "
          "CASE WHEN event_id % 2 = 0 THEN round(air_temperature, 6) END AS air_temperature FROM tower")
def q_csv_column_order(spark, sf):
    """Files with other column orders, and one without a column, are read together by name."""
    import uuid

    from towerfill.session import scratch_path
    path = scratch_path(spark, "columns", uuid.uuid4().hex)
    t = tower(spark, sf)
    _text.write_csv(t.filter("event_id % 2 = 0").select("event_id", "k", "wind_speed", "air_temperature"), f"{path}/a")
    _text.write_csv(t.filter("event_id % 2 = 1").select("wind_speed", "event_id", "k"), f"{path}/b")
    return _text.read_csv(spark, f"{path}/*")


@register("csv_bad_rows", W + " SELECT CAST(event_id AS BIGINT) AS event_id, CASE WHEN event_id % 7 <> 1 THEN CAST(k AS BIGINT) END AS k "
          "FROM tower WHERE event_id % 5 <> 2")
def q_csv_bad_rows(spark, sf):
    """Rows with more fields than the header go (the default raises), rows with fewer are filled with nulls."""
    import uuid

    from towerfill.session import scratch_path
    path = scratch_path(spark, "bad", uuid.uuid4().hex)
    line = (F.when(F.expr("event_id % 5 = 2"), F.concat_ws(",", "event_id", "k", F.lit("extra")))
            .when(F.expr("event_id % 7 = 1"), F.col("event_id").cast("string")).otherwise(F.concat_ws(",", "event_id", "k")))
    _text.write_csv(tower(spark, sf).select(line.alias("event_id,k")), f"{path}/lines", sep="|")  # lines as they are
    return _text.read_csv(spark, f"{path}/lines", bad_rows="drop")


@register("layout_general_formats", W + " SELECT CAST(event_id AS BIGINT) AS event_id, CASE CAST(event_id % 4 AS INT) "
          "WHEN 0 THEN date_trunc('month', datetime) WHEN 1 THEN date_trunc('minute', datetime) WHEN 2 THEN date_trunc('second', datetime) "
          "- INTERVAL 2 HOUR ELSE date_trunc('second', datetime) END AS datetime FROM tower")
def q_layout_general_formats(spark, sf):
    """S4f, C11: yyyyMM, day-first, offset and ISO stamps in one column, parsed by shape."""
    stamp = (F.when(F.expr("event_id % 4 = 0"), _stamp("yyyyMM")).when(F.expr("event_id % 4 = 1"), _stamp("dd/MM/yyyy HH:mm"))
             .when(F.expr("event_id % 4 = 2"), F.concat(_stamp("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
             .otherwise(_stamp("yyyy-MM-dd HH:mm:ss")))
    df, _ = _lay.detect_layout(tower(spark, sf).select(stamp.alias("timestamp"), "event_id"))
    return df.select("event_id", "datetime")


@register("layout_error_label", "SELECT label FROM (VALUES ('UNKNOWN (failed time parse)'), ('FLUXNET (timestamp error)'), "
          "('UNKNOWN (no time column)'), ('GENERAL TIME SERIES')) t(label)")
def q_layout_error_label(spark, sf):
    """Labels of tables whose stamps don't parse, that have no time column, and that are well."""
    t = tower(spark, sf)
    tables = [t.select(F.col("series_id").alias("timestamp"), "k"),
              t.select(F.col("series_id").alias("TIMESTAMP_START"), F.col("series_id").alias("TIMESTAMP_END"), "k"),
              t.select("event_id", "k"), t.select(_stamp("yyyy-MM-dd HH:mm:ss").alias("timestamp"), "k")]
    return spark.createDataFrame([(_lay.detect_layout(x)[1],) for x in tables], "label string")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["fill_routing"](spark, sf_dir)

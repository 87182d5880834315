"""Layout detection and canonical parsing (S4a-S4f, S5, S6, P1, T1-T7).

The layout is chosen at plan time from the column names, first match wins, as in
the reference.  Parsing is column expressions only; a bad stamp becomes null
(``try_to_timestamp`` / ``try_cast``) instead of failing the job (T2, T3).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from towerfill.functions.constants import EC_TOWER_CO2, MISSING_SENTINEL, RENAME_MAP, TIME_COLUMNS

# Shapes of stamps and the patterns tried for each, in order.
DIGITS = {14: "yyyyMMddHHmmss", 12: "yyyyMMddHHmm", 10: "yyyyMMddHH", 8: "yyyyMMdd", 6: "yyyyMM"}
ISO = r"^\d{4}-\d{1,2}(-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?)?$"
OFFSET = r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)? ?(Z|[+-]\d{2}(:?\d{2})?)$"
OTHER_PATTERNS = ["yyyy/M/d H:mm:ss", "yyyy/M/d H:mm", "yyyy/M/d", "d.M.yyyy H:mm:ss", "d.M.yyyy H:mm", "d.M.yyyy"]
SLASHED = ["H:mm:ss", "H:mm", ""]

_NUM = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _as_text(df: DataFrame, c: str) -> Column:
    dt = df.schema[c].dataType
    x = F.col(f"`{c}`")
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        x = x.cast("long")  # 200201010030.0 -> 200201010030
    return F.trim(x.cast("string"))


def parse_pattern(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


def parse_offset(text: Column) -> Column:
    """A stamp with a zone offset as its UTC time."""
    with_t = F.regexp_replace(F.regexp_replace(text, " ?(Z|[+-][0-9:]+)$", "$1"), r"([+-]\d{2})(\d{2})$", "$1:$2")
    micros = F.unix_micros(F.regexp_replace(with_t, r"([+-]\d{2})$", "$1:00").try_cast("timestamp"))
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def parse_auto(text: Column, day_first: bool = False) -> Column:
    """Inferred format, by the stamp's shape: digits only by their number, ISO-8601 (with an offset: in UTC), else the
    patterns above; ``13/02/2024`` by ``day_first``, and by the other order where that gives no date."""
    digits = F.when(F.lit(False), F.lit(None).cast("timestamp_ntz"))
    for n, pattern in DIGITS.items():
        digits = digits.when(F.length(text) == n, parse_pattern(text, pattern))
    orders = ["d/M/yyyy", "M/d/yyyy"] if day_first else ["M/d/yyyy", "d/M/yyyy"]
    other = [*OTHER_PATTERNS, *(f"{d} {t}".strip() for d in orders for t in SLASHED)]
    return (F.when(text.rlike(r"^\d+$"), digits).when(text.rlike(ISO), text.try_cast("timestamp_ntz"))
             .when(text.rlike(OFFSET), parse_offset(text)).otherwise(F.coalesce(*[parse_pattern(text, p) for p in other])))


def is_day_first(df: DataFrame, text: Column) -> bool:
    """Whether a column of slashed dates has the day first: some first number is over 12 (no second number is)."""
    if df.isStreaming:
        return False
    one, two = (F.regexp_extract(text, r"^(\d{1,2})/(\d{1,2})/\d{4}", i).try_cast("int") for i in (1, 2))
    r = df.agg(F.max(one).alias("one"), F.max(two).alias("two")).first()
    return r.one is not None and r.one > 12 and (r.two or 0) <= 12


def parse_fluxnet_aggregated(text: Column) -> Column:
    """S4b per row (T3): 6 digits yyyyMM, 8 yyyyMMdd, 10 yyyyMMddHH, 12 yyyyMMddHHmm, else inferred."""
    n = F.length(text)
    return (F.when(n == 6, parse_pattern(text, "yyyyMM"))
             .when(n == 8, parse_pattern(text, "yyyyMMdd"))
             .when(n == 10, parse_pattern(text, "yyyyMMddHH"))
             .when(n == 12, parse_pattern(text, "yyyyMMddHHmm"))
             .otherwise(parse_auto(text)))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN -> NULL in every floating column (Spark aggregates do not skip NaN)."""
    repl = {f.name: F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType))
            for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.withColumns(repl) if repl else df


def sentinel_to_null(df: DataFrame, sentinels: Sequence[float] = (MISSING_SENTINEL,),
                     skip: Sequence[str] = ()) -> DataFrame:
    """Exact sentinel values -> NULL in every numeric column, one projection."""
    if not sentinels:
        return df
    repl = {}
    for f in df.schema.fields:
        if f.name in skip or not isinstance(f.dataType, _NUM):
            continue
        x = F.col(f"`{f.name}`")
        repl[f.name] = F.when(x.isin(list(sentinels)), F.lit(None).cast(f.dataType)).otherwise(x)
    return df.withColumns(repl) if repl else df


def rename_canonical(df: DataFrame) -> DataFrame:
    """Long EC-tower names -> short names; names mapping to one target are coalesced in map order."""
    groups: dict[str, list[str]] = {}
    for src, dst in RENAME_MAP:
        if src in df.columns and src != dst:
            groups.setdefault(dst, []).append(src)
    if not groups:
        return df
    used = {s for v in groups.values() for s in v}
    cols = [F.col(f"`{c}`") for c in df.columns if c not in used and c not in groups]
    for dst, srcs in groups.items():
        parts = [F.col(f"`{s}`") for s in srcs] + ([F.col(f"`{dst}`")] if dst in df.columns else [])
        cols.append((F.coalesce(*parts) if len(parts) > 1 else parts[0]).alias(dst))
    return df.select(*cols)


def _finish(df: DataFrame, dt: Column, drop: Sequence[str], sentinels: Sequence[float]) -> DataFrame:
    rest = [c for c in df.columns if c not in drop and c != "datetime"]
    out = df.select(dt.alias("datetime"), *[F.col(f"`{c}`") for c in rest])
    return nan_to_null(sentinel_to_null(out, sentinels))


def detect_layout(df: DataFrame, rename: bool = True, sentinels: Sequence[float] | None = None,
                  check: bool | None = None) -> tuple[DataFrame, str]:
    """``(canonical frame, label)``; the frame has a ``datetime`` column first.

    ``sentinels`` overrides the per-layout default (T5: [-9999] for FLUXNET, AmeriFlux
    and ICOS, none otherwise). ``check`` (default: unless streaming) looks for one
    stamp that parses; without any, the label is an error label (T2, T6) and every
    ``datetime`` is null."""
    out, label = _detect(df, rename, sentinels)
    if check is None:
        check = not df.isStreaming
    return out, check_parse(out, label) if check else label


def _detect(df: DataFrame, rename: bool, sentinels: Sequence[float] | None) -> tuple[DataFrame, str]:
    cols = set(df.columns)
    sv = (lambda default: list(default) if sentinels is None else list(sentinels))
    if "TIMESTAMP_START" in cols and "TIMESTAMP_END" in cols:
        dt = parse_pattern(_as_text(df, "TIMESTAMP_START"), "yyyyMMddHHmm")
        return _finish(df, dt, ["TIMESTAMP_START", "TIMESTAMP_END"], sv([MISSING_SENTINEL])), "FLUXNET"
    if "TIMESTAMP" in cols and "NEE_VUT_REF" in cols:
        dt = parse_fluxnet_aggregated(_as_text(df, "TIMESTAMP"))
        return _finish(df, dt, ["TIMESTAMP"], sv([MISSING_SENTINEL])), "FLUXNET"
    if "TIMESTAMP" in cols and "TIMESTAMP_END" in cols:
        text = _as_text(df, "TIMESTAMP")
        dt = parse_auto(text, is_day_first(df, text))
        return _finish(df, dt, ["TIMESTAMP", "TIMESTAMP_END"], sv([MISSING_SENTINEL])), "ICOS"
    if "TIMESTAMP_START" in cols and "FC" in cols:
        dt = parse_pattern(_as_text(df, "TIMESTAMP_START"), "yyyyMMddHHmm")
        return _finish(df, dt, ["TIMESTAMP_START"], sv([MISSING_SENTINEL])), "AMERIFLUX"
    if "date" in cols and "time (UTC)" in cols and EC_TOWER_CO2 in cols:
        text = F.concat_ws(" ", _as_text(df, "date"), _as_text(df, "time (UTC)"))
        out = _finish(df, parse_pattern(text, "dd.MM.yyyy HH:mm:ss"), ["date", "time (UTC)"], sv([]))
        return (rename_canonical(out) if rename else out), "EC Tower"
    found = next((c for c in TIME_COLUMNS if c in cols), None)
    if found is None:
        return nan_to_null(sentinel_to_null(df, sv([]))), "UNKNOWN (no time column)"
    dt_type = df.schema[found].dataType
    if isinstance(dt_type, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        dt = F.col(f"`{found}`").cast("timestamp_ntz")
    else:
        text = _as_text(df, found)
        dt = parse_auto(text, is_day_first(df, text))
    return _finish(df, dt, [found], sv([])), "GENERAL TIME SERIES"


def check_parse(df: DataFrame, label: str) -> str:
    """If no stamp parsed (a search for one), mark the label as a time error."""
    if "UNKNOWN (no" in label or df.filter("datetime is not null").limit(1).count():
        return label
    return "FLUXNET (timestamp error)" if label == "FLUXNET" else "UNKNOWN (failed time parse)"

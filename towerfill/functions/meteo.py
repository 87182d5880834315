"""Meteorological features.

Spark 4 runs in ANSI mode, where even a double division by zero raises; every
division whose divisor can be zero uses ``try_divide`` or is rewritten as a
multiplication (aerodynamic resistance is kept as its inverse, so calm wind
needs no division and gives the same value as the reference's ``x / inf``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from towerfill.functions import constants as K
from towerfill.functions.calendar import pick


def saturation_vp(t: Column) -> Column:
    """Saturation vapour pressure (kPa)."""
    return K.SVP_A * F.exp(F.try_divide(K.SVP_B * t, K.SVP_C + t))


def vpd(t: Column, rh: Column) -> Column:
    """Vapour pressure deficit = svp - svp * RH / 100."""
    svp = saturation_vp(t)
    return svp - svp * rh / 100.0


def vp_slope(t: Column) -> Column:
    """C14: slope of the saturation vapour pressure curve (kPa / degC)."""
    return 4098 * (0.6108 * F.exp(F.try_divide(17.27 * t, t + 237.3))) / F.pow(t + 237.3, 2)


def inverse_aero_resistance(u: Column, height: float = 2.0) -> Column:
    """1 / ra, with ra = ln(h / 0.01)^2 / (0.41^2 * u)."""
    return (K.VON_KARMAN ** 2) * u / (math.log(height / K.ROUGHNESS) ** 2)


def potential_et(t: Column, rh: Column, u: Column, rad: Column, height: float = 2.0) -> Column:
    """Potential ET as the reference writes it (unit mix kept, T14)."""
    delta = vp_slope(t)
    inv_ra = inverse_aero_resistance(u, height)
    rn = rad * K.W_TO_MJ_DAY
    num = delta * rn + K.RHO_AIR * K.CP_AIR * vpd(t, rh) * inv_ra
    den = delta + K.GAMMA_PSY * (1 + K.SURFACE_RESISTANCE * inv_ra)
    return F.try_divide(num, den) / K.LAMBDA_V * 1000 * 86400


def diff_ratio(diffuse: Column, total: Column) -> Column:
    """C17: diffuse / total where total > 0, else null."""
    return F.when(total > 0, F.try_divide(diffuse, total))


def _stability_bin(x: Column) -> Column:
    """Bin number 0..7 of the right-closed Obukhov bins; -inf and null -> null."""
    e = K.STABILITY_EDGES
    c = F.when(x.isNull() | (x == float("-inf")) | F.isnan(x), F.lit(None).cast("int"))
    for i, edge in enumerate(e):
        c = c.when(x <= edge, F.lit(i))
    return c.otherwise(F.lit(len(e)))


def stability_class(x: Column) -> Column:
    """Class label of the Obukhov length."""
    return pick(K.STABILITY_CLASSES, _stability_bin(x))


def stability_index(x: Column) -> Column:
    """Numeric stability index of the same bins."""
    return pick([float(v) for v in K.STABILITY_INDEX], _stability_bin(x))


def wind_sector_index(direction: Column) -> Column:
    """C20: 0..15 sector of ``dir mod 360`` in right-closed 22.5 deg bins, first bin [0, 22.5]."""
    x = F.pmod(direction, F.lit(360.0))
    return (F.when(x.isNull() | F.isnan(x), F.lit(None).cast("int"))
             .when(x <= 22.5, F.lit(0))
             .otherwise(F.ceil(x / 22.5).cast("int") - 1))


def wind_sector(direction: Column) -> Column:
    """C20: sector label N .. NNW."""
    return pick(K.WIND_SECTORS, wind_sector_index(direction))


def add_vpd(df: DataFrame) -> DataFrame:
    if "air_temperature" in df.columns and "relative_humidity" in df.columns:
        return df.withColumn("vpd", vpd(F.col("air_temperature"), F.col("relative_humidity")))
    return df


def add_met_features(df: DataFrame) -> DataFrame:
    """``create_met_features``: each feature only if its inputs exist (C22), one projection."""
    cols = set(df.columns)
    new: list[Column] = []
    has_t, has_rh = "air_temperature" in cols, "relative_humidity" in cols
    has_u, has_tot = "wind_speed" in cols, "downwelling_shortwave_flux_total" in cols
    has_dif = "downwelling_shortwave_flux_diffuse" in cols
    t, rh = F.col("air_temperature"), F.col("relative_humidity")
    if has_t and has_rh and "vpd" not in cols:
        new.append(vpd(t, rh).alias("vpd"))
    if has_t and has_rh and has_u and has_tot:
        new.append(potential_et(t, rh, F.col("wind_speed"), F.col("downwelling_shortwave_flux_total"))
                   .alias("potential_et"))
    if has_tot and has_dif:
        new.append(diff_ratio(F.col("downwelling_shortwave_flux_diffuse"),
                              F.col("downwelling_shortwave_flux_total")).alias("diff_ratio"))
    if "obukhov_length" in cols:
        L = F.col("obukhov_length")
        new += [stability_class(L).alias("stability_class"), stability_index(L).alias("stability_index")]
    if "wind_dir" in cols:
        new.append(wind_sector(F.col("wind_dir")).alias("wind_dir_cat"))
    df = df.select("*", *new)
    if "wind_dir" in cols:
        # All sixteen dummies, null sector -> 0. The lambda keeps Spark from compiling the frame's whole
        # projection into one method, which would be too long for the JVM to compile in its turn.
        sectors = F.array(*[F.lit(s) for s in K.WIND_SECTORS])
        flags = F.transform(sectors, lambda s: F.coalesce((F.col("wind_dir_cat") == s).cast("int"), F.lit(0)))
        kept = [F.col(f"`{c}`") for c in df.columns]
        df = df.withColumn("_sectors", flags).select(*kept, *[F.get("_sectors", F.lit(i)).alias(f"wind_dir_{s}") for i, s in enumerate(K.WIND_SECTORS)])
    return df

"""Flux arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RAD_PARTS = ["downwelling_shortwave_flux", "upwelling_shortwave_flux", "downwelling_longwave_flux",
             "upwelling_longwave_flux"]


def net_radiation(sw_dn: Column, sw_up: Column, lw_dn: Column, lw_up: Column) -> Column:
    """Rnet = (SW down - SW up) + (LW down - LW up)."""
    return (sw_dn - sw_up) + (lw_dn - lw_up)


def energy_balance(h: Column, le: Column) -> Column:
    """H + LE."""
    return h + le


def bowen(h: Column, le: Column) -> Column:
    """H / LE; zero LE gives null (the reference gets inf / NaN, both later dropped)."""
    return F.try_divide(h, le)


def residual(observed: Column, filled: Column) -> Column:
    """Observed - filled."""
    return observed - filled

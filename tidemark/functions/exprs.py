"""Scalar column functions: weather, power, levels, modes, times and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the Magnus formula.
MAGNUS_A, MAGNUS_B = 17.625, 243.04


def dew_point(celsius: Column, humidity: Column) -> Column:
    """Dew point in degrees Celsius; null unless 0 < humidity <= 100."""
    g = F.log(humidity / 100) + MAGNUS_A * celsius / (MAGNUS_B + celsius)
    return F.when((humidity > 0) & (humidity <= 100), MAGNUS_B * g / (MAGNUS_A - g))


def wind(u: Column, v: Column) -> tuple[Column, Column]:
    """Speed, and the direction in degrees that the wind comes from."""
    return F.hypot(u, v), F.pmod(F.lit(270.0) - F.degrees(F.atan2(v, u)), F.lit(360.0))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(F.pmod(lon2 - lon1 + 180, F.lit(360.0)) - 180)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def decibel(x: Column) -> Column:
    return F.when(x > 0, 10 * F.log10(x))


def charge_state(watts: Column, deadband: float) -> Column:
    return F.when(watts > deadband, "charging").when(watts < -deadband, "discharging").when(watts.isNotNull(), "idle").otherwise("unknown")


def soc_step(net: Column, hours: Column, capacity: float, max_charge: float, max_discharge: float, charge_eff: float, discharge_eff: float) -> Column:
    """Points of charge that net watts over some hours add, within the power limits and with the efficiencies."""
    stored = F.least(F.greatest(net, F.lit(0.0)), F.lit(max_charge)) * charge_eff - F.least(F.greatest(-net, F.lit(0.0)), F.lit(max_discharge)) / discharge_eff
    return 100 * stored * hours / (1000 * capacity)


def mode_code(present: Sequence[Column]) -> Column:
    """A bit per component that is present."""
    code = F.lit(0)
    for i, p in enumerate(present):
        code = code + F.when(p, 1 << i).otherwise(0)
    return code


def mode_label(code: Column, names: Sequence[str]) -> Column:
    said = F.concat_ws("+", *[F.when(code.bitwiseAND(F.lit(1 << i)) > 0, n) for i, n in enumerate(names)])
    return F.when(said == "", "idle").otherwise(said)


def quantile_at(rank: Column, p10: Column, p50: Column, p90: Column) -> Column:
    """Piecewise linear through the three quantiles, flat outside."""
    low = p10 + (rank - 0.1) / 0.4 * (p50 - p10)
    high = p50 + (rank - 0.5) / 0.4 * (p90 - p50)
    return F.when(rank <= 0.1, p10).when(rank >= 0.9, p90).when(rank <= 0.5, low).otherwise(high)

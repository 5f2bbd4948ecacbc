"""Fields derived from others.  Constants have fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stagger import unstagger

# Gravity, base temperature and pressure, R/Cp, lapse rate, gas constant of dry air.
GRAVITY = 9.81
BASE_TEMPERATURE = 300.0
BASE_PRESSURE = 100000.0
KAPPA = 0.2854
LAPSE_RATE = 0.0065
GAS_DRY = 287.05


def _doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def geo_height(ph: Column, phb: Column, terrain: Column | None = None) -> Column:
    """Heights of mass levels above the sea from staggered geopotential; above the
    ground if ``terrain`` is given."""
    z = unstagger(F.zip_with(_doubles(ph), _doubles(phb), lambda a, b: (a + b) / GRAVITY))
    return z if terrain is None else F.transform(z, lambda h: h - terrain.cast("double"))


def actual_temperature(t: Column, p: Column, pb: Column) -> Column:
    """Temperature of each level from potential temperature and pressure."""
    pressure = F.zip_with(_doubles(p), _doubles(pb), lambda a, b: F.pow((a + b) / BASE_PRESSURE, F.lit(KAPPA)))
    return F.zip_with(_doubles(t), pressure, lambda a, b: (a + BASE_TEMPERATURE) * b)


def humidity(w: Column) -> Column:
    """Specific humidity from a mixing ratio."""
    return w / (w + 1)


def humidity_levels(w: Column) -> Column:
    return F.transform(_doubles(w), humidity)


def sea_level_pressure(psfc: Column, t2: Column, terrain: Column) -> Column:
    mean_temperature = t2 + LAPSE_RATE * terrain / 2
    return psfc * F.exp(GRAVITY * terrain / (GAS_DRY * mean_temperature))

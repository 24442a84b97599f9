"""Column expressions for aerosol optics, masses and quality flags."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wavelengths in nanometres.
REFERENCE_NM = 550.0
TARGET_NM = 470.0
PHOTOMETER_NM = 675.0

# Factor of each component in the composite mass.
COMPOSITE_FACTORS = {"DUSMASS25": 1.0, "SSSMASS25": 1.0, "BCSMASS": 1.0, "OCSMASS": 1.4, "SO4SMASS": 1.375}


def null_nan(value: Column | str) -> Column:
    """Missing is always null past the readers."""
    return F.nanvl(F.col(value) if isinstance(value, str) else value, F.lit(None).cast("double"))


def masked_by_quality(value: Column, flag: Column, flag_values: Column) -> Column:
    """Keep ``value`` on the two best of four flags, or on the best of two; else null."""
    accepted = F.when(flag_values == 4, flag < 2).otherwise(flag == 0)
    return F.when(accepted, value)


def masked_by_exponent_quality(exponent: Column, flag: Column) -> Column:
    return F.when(flag < 2, exponent)


def to_wavelength(depth: Column, exponent: Column, from_nm: float, to_nm: float) -> Column:
    """Optical depth moved from one wavelength to another along its exponent."""
    return depth * F.pow(F.lit(to_nm / from_nm), -exponent)


def exponent_between(depth_to: Column, depth_from: Column, to_nm: float, from_nm: float) -> Column:
    """Exponent that links two optical depths; null where the ratio is not positive."""
    ratio = F.try_divide(depth_to, depth_from)
    return F.when(ratio > 0, -F.log(ratio) / F.lit(math.log(to_nm / from_nm)))


def composite_mass(factors: dict[str, float] = COMPOSITE_FACTORS) -> Column:
    """Weighted sum of the components; null when any component is null."""
    total = None
    for name, factor in factors.items():
        term = F.col(name) if factor == 1.0 else F.col(name) * F.lit(factor)
        total = term if total is None else total + term
    return total


def positive_log(value: Column) -> Column:
    return F.when(value > 0, F.log(value))

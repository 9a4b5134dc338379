"""Scalar formulas; temperatures in kelvin, pressures in pascal unless a name says otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .core import NAN, fin, finite, ieee_div, ieee_ratio


def saturation_vapour_pressure(t: Column) -> Column:
    """Pa; NaN at or below 0 K; the exponential overflows to infinity by itself."""
    return F.when(t <= 0, F.lit(NAN)).otherwise(F.exp(77.345 + 0.0057 * t - 7235.0 / F.when(t > 0, t)) / F.pow(F.when(t > 0, t), F.lit(8.2)))


def cp_dry(t: Column) -> Column:
    """Heat capacity of dry air, J kg-1 K-1."""
    c = t - K.T0
    return K.CPD + (c + 23.12) * (c + 23.12) / 3364.0


def cp_vapour(t: Column, rh: Column) -> Column:
    """Heat capacity of water vapour, J kg-1 K-1; relative humidity in percent."""
    c = t - K.T0
    return 1859.0 + 0.13 * rh + (0.193 + 5.6e-3 * rh) * c + (1e-3 + 5e-5 * rh) * c * c


def latent_heat(t: Column) -> Column:
    """Latent heat of vaporisation, J kg-1."""
    return 1e3 * (3147.5 - 2.37 * t)


def air_temperature_from_sonic(ts: Column, e: Column, p: Column) -> Column:
    return ieee_ratio(ts, 1.0 + 0.32 * ieee_ratio(e, p))


def flux_factor(vd_mean: Column, density: bool) -> Column:
    """What a kinematic gas flux is multiplied by: 1 for densities, else 1 over the mean dry volume."""
    return F.lit(1.0) if density else ieee_div(F.lit(1.0), vd_mean)


def moist_fraction(r: Column) -> Column:
    """Mole fraction in moist air from a dry ratio."""
    return F.when(1.0 + r > 0, r / F.when(1.0 + r > 0, 1.0 + r)).otherwise(F.when(r.isNotNull(), F.lit(NAN)))


def wind_direction(u: Column, v: Column, north_offset: float = 0.0) -> Column:
    """Degrees clockwise from north that the wind comes from."""
    return F.pmod(180.0 - F.degrees(F.atan2(v, u)) + F.lit(float(north_offset)), F.lit(360.0))


def tstar(cov_w_ts: Column, ustar: Column) -> Column:
    return F.when(finite(ustar) & (ustar > 0), -cov_w_ts / F.when(ustar > 0, ustar))


def standard_deviation(variance: Column) -> Column:
    return F.when(finite(variance) & (variance >= 0), F.sqrt(variance))


def relative_deviation(model: Column, measured: Column) -> Column:
    return F.when(finite(model) & (model != 0), fin(F.abs((model - measured) / F.when(model != 0, model))))


def sst_flag(pct: Column) -> Column:
    """0 up to 30 %, 1 up to 100 %, else 2; 2 also where there is no figure."""
    return F.when(~finite(pct), 2).when(pct <= 30, 0).when(pct <= 100, 1).otherwise(2)


def spectral_factor(z_l: Column, wind_speed: Column, tau: float, height: float) -> Column:
    """First-order recovery factor; NULL if it has no inputs or the height is not positive."""
    if height <= 0:
        return F.lit(None).cast("double")
    stable = z_l > 0
    nm = F.when(stable, 2.0 - 1.915 / (1.0 + 0.5 * F.when(stable, z_l).otherwise(0.0))).otherwise(K.NM_NEUTRAL)
    alpha = F.when(stable, K.ALPHA_STABLE).otherwise(K.ALPHA_UNSTABLE)
    factor = 1.0 + F.pow(2 * math.pi * nm * F.lit(tau) * wind_speed / F.lit(height), alpha)
    return F.when(finite(z_l) & finite(wind_speed), fin(factor))

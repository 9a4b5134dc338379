"""Column functions: missing data, IEEE division, and the scalar formulas."""

from .core import fin, finite, ieee_div, ieee_pow, ieee_ratio, joint
from .physics import (
    air_temperature_from_sonic,
    cp_dry,
    cp_vapour,
    flux_factor,
    latent_heat,
    moist_fraction,
    relative_deviation,
    saturation_vapour_pressure,
    spectral_factor,
    sst_flag,
    standard_deviation,
    tstar,
    wind_direction,
)

__all__ = [
    "air_temperature_from_sonic", "cp_dry", "cp_vapour", "fin", "finite", "flux_factor", "ieee_div", "ieee_pow", "ieee_ratio", "joint", "latent_heat",
    "moist_fraction", "relative_deviation", "saturation_vapour_pressure", "spectral_factor", "sst_flag", "standard_deviation", "tstar", "wind_direction",
]

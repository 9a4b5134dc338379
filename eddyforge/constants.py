"""Physical constants and thresholds that published results depend on."""

from __future__ import annotations

import math

R = 8.314462618  # J mol-1 K-1
RD = 287.04  # J kg-1 K-1, dry air
RV = 461.5  # J kg-1 K-1, water vapour
MD = 0.02897  # kg mol-1
MV = 0.01802
MCO2 = 0.04401
MU = MD / MV
CPD = 1005.0
G = 9.81
KAPPA = 0.4
P0A = 1e5
MAD_SCALE = 0.6745
T0 = 273.15
CANOPY_DISPLACEMENT_RATIO = 2 / 3
Z_MINUS_D_FLOOR = 1e-4

OMEGA = 2 * math.pi / 86400
N_SUBINTERVALS = 5

NM_NEUTRAL = 0.085
ALPHA_UNSTABLE = 7 / 8
ALPHA_STABLE = 1.0
IMPLAUSIBLE_FACTOR = 2.0

TIE_MARGIN = 1 + 1e-12
RATE_TOLERANCE = 0.01
MICROS = 1_000_000

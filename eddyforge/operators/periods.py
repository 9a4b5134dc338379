"""Period steps: column arithmetic on one row per period. Branches of the configuration are taken
when the plan is built; what depends on data is a ``when``."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..config import GASES, Config
from ..functions import fin, finite, flux_factor, ieee_div, ieee_pow, joint, relative_deviation, spectral_factor, standard_deviation, tstar


def assemble(p: DataFrame, cfg: Config) -> DataFrame:
    """Uncorrected fluxes, sensible heat with the humidity part of sonic temperature, stability."""
    c = F.col
    p = p.withColumns({f"f_{g}": flux_factor(c("vd_mean"), cfg.density(g)) for g in GASES})
    p = p.withColumns({"fc_l0": fin(c("cov_w_co2") * c("f_co2")), "fh2o_l0": fin(c("cov_w_h2o") * c("f_h2o"))})
    p = p.withColumn("e_l0", c("fh2o_l0") * K.MV)
    p = p.withColumns({"le_l0": c("e_l0") * c("lambda_v_mean"), "h_l0": c("cov_w_ts") * c("rho_m_mean") * c("cp_mean")})
    ok = joint(c("h_l0"), c("cp_mean"), c("ta_mean"), c("e_l0"), c("q_mean"))
    p = p.withColumn("h", F.when(ok, (c("h_l0") - 0.51 * c("cp_mean") * c("ta_mean") * c("e_l0")) / F.when(1.0 + 0.51 * c("q_mean") != 0, 1.0 + 0.51 * c("q_mean"))))
    p = p.withColumn("theta_s", c("ts_mean") * ieee_pow(ieee_div(F.lit(K.P0A), c("p_air_mean")), 0.286))
    p = p.withColumn("mo_length", ieee_div(-(c("theta_s") * F.pow(c("ustar"), F.lit(3.0))), F.lit(K.KAPPA * K.G) * c("cov_w_ts")))
    return p.withColumn("z_l", ieee_div(F.lit(cfg.height), c("mo_length")))


NEEDED = ("h", "rho_m_mean", "cp_mean", "rho_v_mean", "rho_d_mean", "ta_mean", "lambda_v_mean", "chi_v_mean")
NOT_ZERO = ("rho_m_mean", "cp_mean", "ta_mean", "rho_d_mean")


def wpl(p: DataFrame, cfg: Config) -> DataFrame:
    """Density corrections of the gas fluxes where they are owed: fc, e, le, wpl_applied.

    A density owes the correction. ``off`` withholds what is owed; ``auto`` corrects if anything is
    owed; ``on`` always does. All inputs have to be there, or none of the three is.
    """
    c, mode = F.col, cfg.wpl.enabled
    owed_c, owed_h = cfg.density("co2"), cfg.density("h2o")
    none = F.lit(None).cast("double")
    if mode == "off" or (mode == "auto" and not (owed_c or owed_h)):
        keep = lambda owed, name: none if mode == "off" and owed else c(name)
        return p.withColumns({"fc": keep(owed_c, "fc_l0"), "e": keep(owed_h, "e_l0"), "le": keep(owed_h, "le_l0"), "wpl_applied": F.lit(False)})
    ok = joint(*[c(x) for x in NEEDED])
    for x in NOT_ZERO:
        ok = ok & (c(x) != 0)
    p = p.withColumn("wpl_applied", ok)
    safe = lambda x: F.when(ok, c(x))
    ta, rho_v, rho_d = safe("ta_mean"), safe("rho_v_mean"), safe("rho_d_mean")
    p = p.withColumn("wt", safe("h") / (safe("rho_m_mean") * safe("cp_mean")))
    expansion = 1.0 + K.MU * (rho_v / rho_d)
    f_chi = c("fh2o_l0") + rho_v / K.MV * c("wt") / ta if owed_h else c("fh2o_l0") * (1.0 - safe("chi_v_mean"))
    p = p.withColumn("__wrv", K.MV * f_chi - rho_v * c("wt") / ta)
    p = p.withColumn("e", fin(expansion * (c("__wrv") + rho_v / ta * c("wt"))))
    p = p.withColumn("le", fin(safe("lambda_v_mean") * c("e")))
    rho_c = c("rho_c_mean")
    webb = (c("fc_l0") * K.MCO2 + K.MU * (rho_c / rho_d) * c("__wrv") + expansion * (rho_c / ta) * c("wt")) / K.MCO2
    p = p.withColumn("fc", F.when(ok, fin(webb)) if owed_c else F.when(ok, c("fc_l0")))
    return p.drop("__wrv")


def spectral(p: DataFrame, cfg: Config) -> DataFrame:
    """First-order recovery factors and the fluxes times them; NULL columns where disabled."""
    c = F.col
    if not cfg.spectral.enabled:
        return p.withColumns({n: F.lit(None).cast("double") for n in ("scf_co2", "scf_h2o", "fc_spec", "e_spec", "le_spec")})
    p = p.withColumns({f"scf_{g}": spectral_factor(c("z_l"), c("wind_speed"), getattr(cfg.spectral, f"{g}_tau_s"), cfg.height) for g in GASES})
    return p.withColumns({"fc_spec": c("fc") * c("scf_co2"), "e_spec": c("e") * c("scf_h2o"), "le_spec": c("le") * c("scf_h2o")})


def itc(p: DataFrame, cfg: Config) -> DataFrame:
    """Integral turbulence characteristics of w, u and temperature against their models."""
    c = F.col
    names = ("itc_w", "itc_u", "itc_t")
    coriolis = abs(2 * K.OMEGA * math.sin(math.radians(cfg.site.latitude)))
    p = p.withColumn("tstar", tstar(c("cov_w_ts"), c("ustar")))
    if not cfg.qc.itc or coriolis == 0:
        return p.withColumns({n: F.lit(None).cast("double") for n in names})
    z, us = c("z_l"), c("ustar")
    ok = finite(us) & (us > 0) & finite(z) & (z != 0)
    u = F.when(ok, us)
    x = F.when(ok, z)
    neutral = F.log(F.lit(coriolis) / u)
    sw = F.when(x < -0.2, 1.3 * F.pow(1.0 - 2.0 * F.least(x, F.lit(0.0)), F.lit(1 / 3))).otherwise(0.21 * neutral + 3.1)
    su = F.when(x < -0.2, 4.15 * F.pow(F.abs(x), F.lit(1 / 8))).otherwise(0.44 * neutral + 6.3)
    a = F.abs(x)
    st = F.when(x < -1, F.pow(a, F.lit(-1 / 3))).when(x < -0.0625, F.pow(a, F.lit(-0.25))).when(x < 0.02, 0.5 * F.pow(a, F.lit(-0.5))).otherwise(1.4 * F.pow(a, F.lit(-0.25)))
    ts = F.abs(c("tstar"))
    sd = lambda n: standard_deviation(c(f"var_{n}"))
    values = (relative_deviation(sw, sd("w") / u), relative_deviation(su, sd("u") / u), relative_deviation(st, sd("ts") / F.when(ts != 0, ts)))
    return p.withColumns({n: F.when(ok, v) for n, v in zip(names, values)})

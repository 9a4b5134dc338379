"""Per-sample moist-air thermodynamics in two passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..config import Config
from ..functions import air_temperature_from_sonic, cp_dry, cp_vapour, fin, ieee_ratio, latent_heat, saturation_vapour_pressure
from .common import need

#: Quantities whose means are published or used later, each the mean of the quantity itself.
QUANTITIES = ("ta", "ts", "p_air", "pd", "e", "es", "rh", "chi_v", "va", "vd", "n_d", "rho_v", "rho_d", "rho_m", "rho_c", "q", "sigma", "cp", "cp_d", "cp_v", "lambda_v")


def thermodynamics(df: DataFrame, cfg: Config) -> DataFrame:
    """Adds t_<quantity> for each of QUANTITIES, and ta_measured (whether ta came from a sensor).

    Air temperature is the measured one, else the sonic one less its humidity part, else the sonic
    one, sample by sample. All are NULL where not finite.
    """
    need(df, "thermodynamics", "ts", "p_air", "h2o", "co2", "ta")
    c, dense, dense_c = F.col, cfg.density("h2o"), cfg.density("co2")
    ts, p, h2o = c("ts"), c("p_air"), c("h2o")
    df = df.withColumn("__rho_a", h2o * K.MV if dense else ieee_ratio(ieee_ratio(h2o, 1.0 + h2o) * K.MV * p, K.R * ts))
    df = df.withColumn("__e_a", c("__rho_a") * K.RV * ts)
    df = df.withColumn("t_ta", F.coalesce(fin(c("ta")), fin(air_temperature_from_sonic(ts, c("__e_a"), p)), ts))
    ta = c("t_ta")
    df = df.withColumn("t_va", ieee_ratio(K.R * ta, p))
    if dense:
        df = df.withColumns({"t_rho_v": c("__rho_a"), "t_chi_v": ieee_ratio(c("__rho_a") * K.R * ta, K.MV * p)})
    else:
        df = df.withColumn("t_chi_v", ieee_ratio(h2o, 1.0 + h2o))
        df = df.withColumn("t_rho_v", ieee_ratio(c("t_chi_v") * K.MV, c("t_va")))
    df = df.withColumns({"t_e": c("t_rho_v") * K.RV * ta, "t_es": saturation_vapour_pressure(ta)})
    df = df.withColumns({"t_rh": ieee_ratio(100.0 * c("t_e"), c("t_es")), "t_pd": p - c("t_e")})
    df = df.withColumns({"t_vd": ieee_ratio(K.R * ta, c("t_pd")), "t_n_d": ieee_ratio(c("t_pd"), K.R * ta), "t_rho_d": ieee_ratio(c("t_pd"), K.RD * ta)})
    df = df.withColumns({"t_rho_m": c("t_rho_d") + c("t_rho_v"), "t_sigma": ieee_ratio(c("t_rho_v"), c("t_rho_d"))})
    df = df.withColumns({"t_q": ieee_ratio(c("t_rho_v"), c("t_rho_m")), "t_cp_d": cp_dry(ta), "t_cp_v": cp_vapour(ta, c("t_rh")), "t_lambda_v": latent_heat(ta)})
    n_co2 = c("co2") if dense_c else c("co2") * c("t_n_d")
    df = df.withColumns({"t_cp": (1.0 - c("t_q")) * c("t_cp_d") + c("t_q") * c("t_cp_v"), "t_rho_c": n_co2 * K.MCO2, "t_ts": ts, "t_p_air": p, "ta_measured": fin(c("ta")).isNotNull(), "__co2": c("co2"), "__h2o": h2o})
    return df.withColumns({f"t_{q}": fin(c(f"t_{q}")) for q in QUANTITIES}).drop("__rho_a", "__e_a")

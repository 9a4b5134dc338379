"""From samples to one row per period: moments, means, counts and the steady-state test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..config import Config
from ..functions import fin, sst_flag
from . import kernels as N
from .common import INDEX, keys
from .lag import FIELDS
from .thermo import QUANTITIES

VARIANCES = ("u", "v", "w", "ts")
COVARIANCES = (("u", "v"), ("u", "w"), ("v", "w"), ("w", "ts"), ("w", "co2"), ("w", "h2o"))


def summarise(df: DataFrame, cfg: Config) -> DataFrame:
    """One aggregate per period over the frame's own partitioning.

    ``n_in`` and ``n_dup`` are columns of the samples. The steady-state pair is cut into five runs of
    n_in div 5 rows, NULL rows counted; what is left over is in the total alone.
    """
    c = F.col
    has = set(df.columns)
    agg = [F.first(x).alias(x) for x in ("period_start_us", "n_in", "n_dup") if x in has]
    carried = [x for x in ("u_unrot_mean", "v_unrot_mean", "w_unrot_mean", "wind_speed", "wind_dir", "theta", "phi") if x in has]
    carried += [x for x in df.columns if x.startswith("n_spike_")]
    carried += [f"{s}_{n}" for s in cfg.lag.scalars for n, _ in FIELDS if f"{s}_{n}" in has]
    carried += [x for x in (f"{n}_mean" for n in cfg.detrend.variables) if x in has]
    agg += [F.max(x).alias(x) for x in carried]  # alike on all samples, or on the first alone
    agg += [F.avg(n).alias(f"{n}_mean") for n in cfg.detrend.variables if n in has and f"{n}_mean" not in carried]
    agg += [F.avg(f"t_{q}").alias(f"{q}_mean") for q in QUANTITIES if f"t_{q}" in has and q not in cfg.detrend.variables]
    if "ta_measured" in has:
        agg += [F.count_if("ta_measured").alias("n_ta_source_measured"), F.avg("__co2").alias("__co2_mean"), F.avg("__h2o").alias("__h2o_mean")]
    if "cell_factor" in has:
        agg += [F.avg(x).alias(f"{x}_mean") for x in ("t_cell", "p_cell", "v_cell", "chi_h2o_cell")] + [F.count("cell_factor").alias("n_cell_converted")]
    agg += [F.var_samp(x).alias(f"var_{x}") for x in VARIANCES]
    agg += [F.covar_samp(x, y).alias(f"cov_{x}_{y}") for x, y in COVARIANCES]
    agg += [N.pairs(c("w"), c(x)).alias(f"n_cov_w_{x}") for x in ("ts", "co2", "h2o")]
    x, y = cfg.qc.steady_state_pair
    if x in has and y in has:
        m = F.floor(c("n_in") / K.N_SUBINTERVALS)
        agg += [F.covar_samp(N.within(c(x), c(INDEX), j * m, (j + 1) * m), c(y)).alias(f"__c{j}") for j in range(K.N_SUBINTERVALS)]
        agg.append(F.covar_samp(x, y).alias("__ct"))
    p = df.groupBy(*keys(df)).agg(*agg)
    p = p.withColumn("ustar", F.pow(c("cov_u_w") * c("cov_u_w") + c("cov_v_w") * c("cov_v_w"), F.lit(0.25)))
    if "ta_measured" in has:
        scale = lambda g: c("n_d_mean") if cfg.density(g) else F.lit(1.0)
        p = p.withColumns({"co2_dry_ppm": 1e6 * c("__co2_mean") / F.when(scale("co2") != 0, scale("co2")), "h2o_dry_ppt": 1e3 * c("__h2o_mean") / F.when(scale("h2o") != 0, scale("h2o"))}).drop("__co2_mean", "__h2o_mean")
    if x in has and y in has:
        return steady_state(p)
    return p.withColumns({"sst_pct": F.lit(None).cast("double"), "sst_flag": F.lit(2)})


def steady_state(p: DataFrame) -> DataFrame:
    """sst_pct and sst_flag from the five covariances and the total, which are dropped."""
    parts = [F.col(f"__c{j}") for j in range(K.N_SUBINTERVALS)]
    total, n = F.lit(0.0), F.lit(0)
    for x in parts:
        total, n = total + F.coalesce(x, F.lit(0.0)), n + F.when(x.isNotNull(), 1).otherwise(0)
    mean = total / F.when(n > 0, n)
    ct = F.col("__ct")
    pct = fin(100.0 * F.abs((mean - ct) / F.when(ct != 0, ct)))
    return p.withColumn("sst_pct", pct).withColumn("sst_flag", sst_flag(F.col("sst_pct"))).drop("__ct", *[f"__c{j}" for j in range(K.N_SUBINTERVALS)])

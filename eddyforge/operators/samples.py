"""Sample steps before the lag search: cell conversion, despiking, rotation; and after it: detrending."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..config import Config
from ..functions import fin, moist_fraction, wind_direction
from . import kernels as N
from .common import INDEX, mask_where, need, over, whole


def convert_cell(df: DataFrame, cfg: Config) -> DataFrame:
    """Closed-path densities in the cell become dry mixing ratios, sample by sample.

    Adds v_cell, chi_h2o_cell and cell_factor. Without a gas to convert the frame is unchanged. The
    water vapour fraction comes from h2o as it was read, also when h2o itself is converted.
    """
    if not cfg.convert_cell:
        return df
    need(df, "convert_cell", "t_cell", "p_cell", "h2o", *cfg.convert_cell)
    ok = (F.col("t_cell") > 0) & (F.col("p_cell") > 0)
    df = df.withColumn("v_cell", fin(F.when(ok, K.R * F.col("t_cell") / F.when(F.col("p_cell") > 0, F.col("p_cell")))))
    chi = F.col("h2o") * F.col("v_cell") if cfg.reported["h2o"] == "molar_density" else moist_fraction(F.col("h2o"))
    df = df.withColumn("chi_h2o_cell", fin(chi))
    dry = 1.0 - F.col("chi_h2o_cell")
    df = df.withColumn("cell_factor", fin(F.when(dry > 0, F.col("v_cell") / F.when(dry > 0, dry))))
    return df.withColumns({g: fin(F.col(g) * F.col("cell_factor")) for g in cfg.convert_cell})


def despike(df: DataFrame, cfg: Config) -> DataFrame:
    """Values outside median -+ q * MAD / 0.6745 become NULL, each variable by itself.

    A run of spikes that reaches the period's last sample is kept. Adds n_spike_<var> (0 when
    disabled). A MAD of zero flags all that differs from the median.
    """
    names = [n for n in cfg.despike.variables if n in df.columns]
    if not cfg.despike.enabled:
        return df.withColumns({f"n_spike_{n}": F.lit(0).cast("long") for n in names})
    w = whole(df)
    df = df.withColumns({f"__med_{n}": F.median(n).over(w) for n in names})
    df = df.withColumns({f"__mad_{n}": F.median(N.deviation(F.col(n), F.col(f"__med_{n}"))).over(w) for n in names})
    flags = {f"__flag_{n}": N.spike_flag(F.col(n), *N.spike_bounds(F.col(f"__med_{n}"), F.col(f"__mad_{n}"), cfg.despike.q)) for n in names}
    df = df.withColumns(flags)
    df = df.withColumns({f"__last_{n}": F.max(F.when(~F.col(f"__flag_{n}"), F.col(INDEX))).over(w) for n in names})
    df = df.withColumns({f"__flag_{n}": F.col(f"__flag_{n}") & (F.col(INDEX) < F.coalesce(F.col(f"__last_{n}"), F.lit(-1))) for n in names})
    df = df.withColumns({n: mask_where(F.col(f"__flag_{n}"), F.col(n)) for n in names} | {f"n_spike_{n}": F.count_if(F.col(f"__flag_{n}")).over(w) for n in names})
    return df.drop(*[f"__{k}_{n}" for k in ("med", "mad", "flag", "last") for n in names])


def rotate(df: DataFrame, cfg: Config) -> DataFrame:
    """Double rotation into the mean wind, or none.

    Adds u/v/w_unrot_mean, wind_speed, wind_dir, theta, phi (radians). The second angle is of the
    mean of the once rotated u, which differs from a closed form where components miss samples.
    """
    need(df, "rotate", "u", "v", "w")
    means = over(df, *[F.avg(n) for n in "uvw"])
    df = df.withColumns({f"{n}_unrot_mean": m for n, m in zip("uvw", means)})
    um, vm = F.col("u_unrot_mean"), F.col("v_unrot_mean")
    df = df.withColumns({"wind_speed": F.hypot(um, vm), "wind_dir": wind_direction(um, vm, cfg.site.north_offset)})
    if cfg.rotate.method == "none":
        return df.withColumns({"theta": F.lit(0.0), "phi": F.lit(0.0)})
    df = df.withColumn("theta", F.atan2(vm, um))
    c, s = F.cos("theta"), F.sin("theta")
    df = df.withColumns({"u": F.col("u") * c + F.col("v") * s, "v": -F.col("u") * s + F.col("v") * c})
    df = df.withColumn("phi", F.atan2(F.col("w_unrot_mean"), over(df, F.avg("u"))[0]))
    c, s = F.cos("phi"), F.sin("phi")
    return df.withColumns({"u": F.col("u") * c + F.col("w") * s, "w": -F.col("u") * s + F.col("w") * c})


def detrend(df: DataFrame, cfg: Config) -> DataFrame:
    """Block: nothing to subtract, covariances take their own means and ``summarise`` the series'.
    Linear: subtracts each variable's least-squares line on the row index and adds <var>_mean of the
    series before."""
    if cfg.detrend.method == "block":
        return df
    names = [n for n in cfg.detrend.variables if n in df.columns]
    w = whole(df)
    means = {f"{n}_mean": F.avg(n).over(w) for n in names}
    i = F.col(INDEX).cast("double")
    out = means | {f"__slope_{n}": F.when(F.count(n).over(w) < 3, 0.0).otherwise(F.regr_slope(F.col(n), i).over(w)) for n in names}
    out |= {f"__offset_{n}": F.when(F.count(n).over(w) < 3, F.avg(n).over(w)).otherwise(F.regr_intercept(F.col(n), i).over(w)) for n in names}
    df = df.withColumns(out)
    df = df.withColumns({n: F.col(n) - (F.col(f"__slope_{n}") * i + F.col(f"__offset_{n}")) for n in names})
    return df.drop(*[f"__{k}_{n}" for k in ("slope", "offset") for n in names])


def rotation_residuals(df: DataFrame) -> DataFrame:
    """Diagnostics per period: how far the rotated means are from (wind along u, 0, 0), over
    max(wind speed, 1)."""
    from .common import keys

    scale = F.greatest(F.first("wind_speed"), F.lit(1.0))
    return df.groupBy(*keys(df)).agg((F.abs(F.avg("v")) / scale).alias("v_residual"), (F.abs(F.avg("w")) / scale).alias("w_residual"))




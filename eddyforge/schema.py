"""The published table: names, where they come from, units and scale."""

from __future__ import annotations

import math

#: Fixed values, in order: published name, column of the period frame, published unit.
COLUMNS = (
    ("TIMESTAMP_START", "period_start", "YYYYMMDDHHMM"),
    ("TIMESTAMP_END", "period_end", "YYYYMMDDHHMM"),
    ("N_IN", "n_in", "samples"),
    ("N_DUP", "n_dup", "samples"),
    ("N_SPIKE_U", "n_spike_u", "samples"),
    ("N_SPIKE_V", "n_spike_v", "samples"),
    ("N_SPIKE_W", "n_spike_w", "samples"),
    ("N_SPIKE_TS", "n_spike_ts", "samples"),
    ("N_SPIKE_CO2", "n_spike_co2", "samples"),
    ("N_SPIKE_H2O", "n_spike_h2o", "samples"),
    ("N_CELL_CONV", "n_cell_converted", "samples"),
    ("WS", "wind_speed", "m s-1"),
    ("WD", "wind_dir", "deg from north"),
    ("THETA", "theta", "deg"),
    ("PHI", "phi", "deg"),
    ("USTAR", "ustar", "m s-1"),
    ("MO_LENGTH", "mo_length", "m"),
    ("ZL", "z_l", "-"),
    ("TA", "ta_mean", "K"),
    ("T_SONIC", "ts_mean", "K"),
    ("PA", "p_air_mean", "Pa"),
    ("T_CELL", "t_cell_mean", "K"),
    ("P_CELL", "p_cell_mean", "Pa"),
    ("RH", "rh_mean", "%"),
    ("CO2_MEAN", "co2_dry_ppm", "umol mol-1 (dry air)"),
    ("H2O_MEAN", "h2o_dry_ppt", "mmol mol-1 (dry air)"),
    ("RHO_A", "rho_m_mean", "kg m-3 (moist air)"),
    ("Q", "q_mean", "kg kg-1"),
    ("CP", "cp_mean", "J kg-1 K-1"),
    ("LAMBDA_V", "lambda_v_mean", "J kg-1"),
    ("VAR_U", "var_u", "m2 s-2"),
    ("VAR_V", "var_v", "m2 s-2"),
    ("VAR_W", "var_w", "m2 s-2"),
    ("VAR_TS", "var_ts", "K2"),
    ("COV_U_W", "cov_u_w", "m2 s-2"),
    ("COV_V_W", "cov_v_w", "m2 s-2"),
    ("COV_W_TS", "cov_w_ts", "K m s-1"),
    ("CO2_LAG", "co2_lag", "s"),
    ("CO2_LAG_OPT", "co2_lag_opt", "s"),
    ("CO2_LAG_DEFAULT", "co2_lag_default_used", "0/1"),
    ("H2O_LAG", "h2o_lag", "s"),
    ("H2O_LAG_OPT", "h2o_lag_opt", "s"),
    ("H2O_LAG_DEFAULT", "h2o_lag_default_used", "0/1"),
    ("H_L0", "h_l0", "W m-2"),
    ("H", "h", "W m-2"),
    ("FC_L0", "fc_l0", "umol m-2 s-1"),
    ("FC", "fc", "umol m-2 s-1"),
    ("LE_L0", "le_l0", "W m-2"),
    ("LE", "le", "W m-2"),
    ("E_L0", "e_l0", "g m-2 s-1"),
    ("E", "e", "g m-2 s-1"),
    ("WPL_APPLIED", "wpl_applied", "0/1"),
    ("SCF_CO2", "scf_co2", "-"),
    ("SCF_H2O", "scf_h2o", "-"),
    ("FC_SPEC", "fc_spec", "umol m-2 s-1"),
    ("LE_SPEC", "le_spec", "W m-2"),
    ("E_SPEC", "e_spec", "g m-2 s-1"),
    ("SST_PCT", "sst_pct", "%"),
    ("SST_FLAG", "sst_flag", "0/1/2"),
    ("ITC_W", "itc_w", "fraction"),
    ("ITC_U", "itc_u", "fraction"),
    ("ITC_T", "itc_t", "fraction"),
)
TIMESTAMPS = ("period_start", "period_end")
FLAGS = ("co2_lag_default_used", "h2o_lag_default_used", "wpl_applied")
COUNTS = ("n_in", "n_dup", "n_spike_u", "n_spike_v", "n_spike_w", "n_spike_ts", "n_spike_co2", "n_spike_h2o", "n_cell_converted", "sst_flag")
#: From the engine's unit to the published one.
SCALE = {"theta": 180.0 / math.pi, "phi": 180.0 / math.pi, "fc_l0": 1e6, "fc": 1e6, "fc_spec": 1e6, "e_l0": 1e3, "e": 1e3, "e_spec": 1e3}

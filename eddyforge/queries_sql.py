"""DuckDB SQL that checks the queries: one chain of common table expressions from the event table to
the published row, written from the definitions, and a final SELECT for each query."""

from __future__ import annotations

import math

from . import constants as K
from .schema import COLUMNS, FLAGS, SCALE, TIMESTAMPS
from .sources.events import DAY, G3, SIGNALS

#: (factor, decimals) by which a figure is rounded on both sides; (1, 6) where there is none.
DIGITS: dict[str, tuple[float, int]] = {
    "co2_mean": (1e6, 5), "co2_med": (1e6, 5), "co2_mad": (1e6, 5), "h2o_mean": (1e3, 6), "h2o_med": (1e3, 6), "h2o_mad": (1e3, 6),
    "p_air_mean": (1, 3), "pd_mean": (1, 3), "e_mean": (1, 4), "es_mean": (1, 4), "rh_mean": (1, 5), "chi_v_mean": (1e3, 6), "n_d_mean": (1, 6), "rho_v_mean": (1e3, 6),
    "rho_c_mean": (1e6, 4), "q_mean": (1e3, 6), "sigma_mean": (1e3, 6), "cp_mean": (1, 4), "cp_d_mean": (1, 4), "cp_v_mean": (1, 4), "lambda_v_mean": (1, 1), "va_mean": (1e3, 6),
    "vd_mean": (1e3, 6), "cov_w_co2": (1e6, 5), "cov_w_h2o": (1e3, 6), "cov": (1e6, 5), "f_co2": (1, 5), "fc_l0": (1e6, 4), "fc": (1e6, 4), "fc_spec": (1e6, 4),
    "fh2o_l0": (1e3, 5), "e_l0": (1e3, 5), "e": (1e3, 5), "e_spec": (1e3, 5), "le_l0": (1, 3), "le": (1, 3), "le_spec": (1, 3), "h_l0": (1, 3), "h": (1, 3), "mo_length": (1, 5),
    "es": (1, 4), "lambda_v": (1, 1), "cp_d": (1, 4), "cp_v": (1, 4), "co2_dry_ppm": (1, 4), "h2o_dry_ppt": (1, 5), "p_cell_mean": (1, 3), "v_cell_mean": (1e3, 6),
    "chi_h2o_cell_mean": (1e3, 6), "sst_pct": (1, 4), "rho_m_mean": (1, 6), "itc_t": (1, 5), "itc_w": (1, 5), "itc_u": (1, 5), "wt": (1, 6),
}
SIX = ("u", "v", "w", "ts", "co2", "h2o")
QUANTITIES = ("ta", "ts", "p_air", "pd", "e", "es", "rh", "chi_v", "va", "vd", "n_d", "rho_v", "rho_d", "rho_m", "rho_c", "q", "sigma", "cp", "cp_d", "cp_v", "lambda_v")
P, B = "period_end_us", "PARTITION BY period_end_us"


def r(expr: str, name: str, own: str | None = None) -> str:
    f, d = DIGITS.get(own or name, (1, 6))
    return f"round(({expr}) * {float(f)!r}::DOUBLE, {d}) AS {name}"


def every(fmt: str, names, sep: str = ", ") -> str:
    return sep.join(fmt.format(n=n) for n in names)


def chain(density: bool = False, cell: bool = False, closed: str = "right", linear: bool = False, despiked: bool = True) -> str:
    """CTEs: smp (samples), d (despiked), r2 (rotated), curve, sel, sh (shifted), th, per."""
    key = "key_us-1" if closed == "right" else "key_us"
    period = f"({key}) - (({key}) % {DAY}) + {DAY}"
    t, p = ("t_cell", "p_cell") if cell else ("ts", "p_air")
    wet = f"* ({p} / ({K.R} * {t}) / (1e0 + h2o))" if density or cell else ""
    c = f"""
e0 AS (SELECT event_id, epoch_us(ts) AS key_us, user_id, event_type, value, (CAST(json_extract_string(props,'$.k') AS INTEGER) - 49.5e0)/50e0 AS g FROM events),
e1 AS (SELECT *, (key_us-1) - ((key_us-1) % {DAY}) + {DAY} AS period_end_us FROM e0), e2 AS (SELECT *, {G3} AS g3 FROM e1),
sig AS (SELECT event_id, key_us, {", ".join(f"{sql} AS {n}" for n, sql in SIGNALS.items())} FROM e2),
cut AS (SELECT *, {period} AS period_end_us FROM sig),
smp0 AS (SELECT *, row_number() OVER ({B} ORDER BY key_us) - 1 AS i, count(*) OVER ({B}) AS n_in FROM cut),
smp AS (SELECT * REPLACE (co2 {wet} AS co2, h2o {wet} AS h2o) FROM smp0)"""
    last = "smp"
    if cell:
        c += f""",
cv AS (SELECT *, {K.R} * t_cell / p_cell AS v_cell, h2o * ({K.R} * t_cell / p_cell) AS chi_h2o_cell FROM smp),
cx AS (SELECT * REPLACE (co2 * (v_cell / (1e0 - chi_h2o_cell)) AS co2, h2o * (v_cell / (1e0 - chi_h2o_cell)) AS h2o), v_cell / (1e0 - chi_h2o_cell) AS cell_factor FROM cv)"""
        last = "cx"
    c += f""",
med AS (SELECT *, {every("median({n}) OVER (" + B + ") AS m_{n}", SIX)} FROM {last}),
mads AS (SELECT *, {every("median(abs({n} - m_{n})) OVER (" + B + ") AS d_{n}", SIX)} FROM med),
flg AS (SELECT *, {every("coalesce({n} < m_{n} - (7e0 * d_{n}) / 0.6745e0 OR {n} > m_{n} + (7e0 * d_{n}) / 0.6745e0, false) AS f_{n}", SIX)} FROM mads),
lst AS (SELECT *, {every("coalesce(max(i) FILTER (WHERE NOT f_{n}) OVER (" + B + "), -1) AS l_{n}", SIX)} FROM flg),
d AS (SELECT * REPLACE ({every("CASE WHEN f_{n} AND i < l_{n} THEN NULL ELSE {n} END AS {n}", SIX)}), {every("(f_{n} AND i < l_{n}) AS s_{n}", SIX)} FROM lst),
mean AS (SELECT *, {every("avg({n}) OVER (" + B + ") AS {n}_um", "uvw")} FROM d),
r1 AS (SELECT * REPLACE (u * cos(atan2(v_um, u_um)) + v * sin(atan2(v_um, u_um)) AS u, -u * sin(atan2(v_um, u_um)) + v * cos(atan2(v_um, u_um)) AS v), atan2(v_um, u_um) AS theta FROM mean),
rp AS (SELECT *, atan2(w_um, avg(u) OVER ({B})) AS phi FROM r1),
r2 AS (SELECT * REPLACE (u * cos(phi) + w * sin(phi) AS u, -u * sin(phi) + w * cos(phi) AS w) FROM rp),
ctr AS (SELECT period_end_us, i, w - avg(w) OVER ({B}) AS a, co2 - avg(co2) OVER ({B}) AS bc, h2o - avg(h2o) OVER ({B}) AS bh FROM r2),
lags AS (SELECT unnest(range(-8, 9)) AS lag),
prod AS (SELECT x.period_end_us, l.lag, x.a, y.bc, y.bh FROM ctr x CROSS JOIN lags l JOIN ctr y ON y.period_end_us = x.period_end_us AND y.i = x.i + l.lag),
curve AS (SELECT period_end_us, lag, count(a * bc) AS n, (sum(a * bc) - sum(a) FILTER (WHERE bc IS NOT NULL) * sum(bc) FILTER (WHERE a IS NOT NULL) / count(a * bc)) / (count(a * bc) - 1) AS cov,
  (sum(a * bh) - sum(a) FILTER (WHERE bh IS NOT NULL) * sum(bh) FILTER (WHERE a IS NOT NULL) / count(a * bh)) / (count(a * bh) - 1) AS covh FROM prod GROUP BY ALL),
sel AS (SELECT period_end_us, arg_max(lag, abs(cov)) AS bc, arg_max(cov, abs(cov)) AS covc, arg_max(lag, abs(covh)) AS bh FROM curve GROUP BY ALL),
sel2 AS (SELECT *, CASE WHEN abs(bc) = 8 THEN 0 ELSE bc END AS lc, CASE WHEN abs(bh) = 8 THEN 0 ELSE bh END AS lh FROM sel),
sh AS (SELECT r.* REPLACE (y.co2 AS co2, z.h2o AS h2o), s.lc, s.bc, s.lh, s.bh FROM r2 r JOIN sel2 s ON s.period_end_us = r.period_end_us
  LEFT JOIN r2 y ON y.period_end_us = r.period_end_us AND y.i = r.i + s.lc LEFT JOIN r2 z ON z.period_end_us = r.period_end_us AND z.i = r.i + s.lh)"""
    return c


def thermo(source: str, density: bool) -> str:
    """th: the sample quantities of a CTE, as t_<name>."""
    R, RV, RD, MV = K.R, K.RV, K.RD, K.MV
    a = f"h2o * {MV}" if density else f"(h2o / (1e0 + h2o)) * {MV} * p_air / ({R} * ts)"
    v = f"(h2o * {MV}) AS t_rho_v, (h2o * {MV}) * {R} * t_ta / ({MV} * p_air) AS t_chi_v" if density else f"(h2o / (1e0 + h2o)) AS t_chi_v, (h2o / (1e0 + h2o)) * {MV} / ({R} * t_ta / p_air) AS t_rho_v"
    n = "co2" if density else "co2 * t_n_d"
    return f""",
ta1 AS (SELECT *, coalesce(ta, ts / (1e0 + 0.32e0 * (({a}) * {RV} * ts) / p_air), ts) AS t_ta FROM {source}),
ta2 AS (SELECT *, {R} * t_ta / p_air AS t_va, {v} FROM ta1),
ta3 AS (SELECT *, t_rho_v * {RV} * t_ta AS t_e, exp(77.345e0 + 0.0057e0 * t_ta - 7235e0 / t_ta) / pow(t_ta, 8.2e0) AS t_es FROM ta2),
ta4 AS (SELECT *, 100e0 * t_e / t_es AS t_rh, p_air - t_e AS t_pd FROM ta3),
ta5 AS (SELECT *, {R} * t_ta / t_pd AS t_vd, t_pd / ({R} * t_ta) AS t_n_d, t_pd / ({RD} * t_ta) AS t_rho_d FROM ta4),
ta6 AS (SELECT *, t_rho_d + t_rho_v AS t_rho_m, t_rho_v / t_rho_d AS t_sigma, t_rho_v / (t_rho_d + t_rho_v) AS t_q, t_ta - 273.15e0 AS tc FROM ta5),
ta7 AS (SELECT *, 1005e0 + (tc + 23.12e0) * (tc + 23.12e0) / 3364e0 AS t_cp_d, 1859e0 + 0.13e0 * t_rh + (0.193e0 + 5.6e-3 * t_rh) * tc + (1e-3 + 5e-5 * t_rh) * tc * tc AS t_cp_v, 1e3 * (3147.5e0 - 2.37e0 * t_ta) AS t_lambda_v FROM ta6),
th AS (SELECT *, (1e0 - t_q) * t_cp_d + t_q * t_cp_v AS t_cp, {n} * {K.MCO2} AS t_rho_c, ts AS t_ts, p_air AS t_p_air FROM ta7)"""


def periods(density: bool = False, cell: bool = False, wpl: str = "auto", spectral: bool = False) -> str:
    """The chain to pr, one row per period with every figure."""
    dense = density and not cell
    covs = (("u", "v"), ("u", "w"), ("v", "w"), ("w", "ts"), ("w", "co2"), ("w", "h2o"))
    runs = ", ".join(f"covar_samp(w, co2) FILTER (WHERE i >= {j} * (n_in // 5) AND i < {j + 1} * (n_in // 5)) AS c{j}" for j in range(5))
    cells = "avg(t_cell) AS t_cell_mean, avg(p_cell) AS p_cell_mean, count(cell_factor) AS n_cell_converted," if cell else "NULL::DOUBLE AS t_cell_mean, NULL::DOUBLE AS p_cell_mean, NULL::DOUBLE AS n_cell_converted,"
    f = "1e0" if dense else "1e0 / vd_mean"
    scale = "/ n_d_mean" if dense else ""
    cor = abs(2 * K.OMEGA * math.sin(math.radians(48.85)))
    z = 3.0 - K.Z_MINUS_D_FLOOR
    if wpl == "off" and dense:
        w = "NULL::DOUBLE AS wt, NULL::DOUBLE AS fc, NULL::DOUBLE AS e, NULL::DOUBLE AS le, false AS wpl_applied"
        ws = "p3"
    elif dense:
        w = f"""lambda_v_mean * e AS le, (fc_l0 * {K.MCO2} + {K.MU} * (rho_c_mean / rho_d_mean) * wrv + expansion * (rho_c_mean / ta_mean) * wt) / {K.MCO2} AS fc, true AS wpl_applied"""
        ws = f"""(SELECT *, expansion * (wrv + (rho_v_mean / ta_mean) * wt) AS e FROM (SELECT *, {K.MV} * (fh2o_l0 + (rho_v_mean / {K.MV}) * wt / ta_mean) - rho_v_mean * wt / ta_mean AS wrv,
  1e0 + {K.MU} * (rho_v_mean / rho_d_mean) AS expansion FROM (SELECT *, h / (rho_m_mean * cp_mean) AS wt FROM p3)))"""
    else:
        w, ws = "fc_l0 AS fc, e_l0 AS e, le_l0 AS le, false AS wpl_applied", "p3"
    factor = lambda tau: f"1e0 + pow(2e0 * pi() * (CASE WHEN z_l > 0 THEN 2e0 - 1.915e0 / (1e0 + 0.5e0 * z_l) ELSE 0.085e0 END) * {tau} * wind_speed / {z!r}::DOUBLE, CASE WHEN z_l > 0 THEN 1e0 ELSE 0.875e0 END)"
    if spectral:
        s = f"{factor('0.13e0')} AS scf_co2, {factor('0.2e0')} AS scf_h2o"
        s2 = "fc * scf_co2 AS fc_spec, e * scf_h2o AS e_spec, le * scf_h2o AS le_spec"
    else:
        s = "NULL::DOUBLE AS scf_co2, NULL::DOUBLE AS scf_h2o"
        s2 = "NULL::DOUBLE AS fc_spec, NULL::DOUBLE AS e_spec, NULL::DOUBLE AS le_spec"
    return f"""{chain(density, cell)}{thermo("sh", dense)},
p1 AS (SELECT period_end_us, any_value(n_in) AS n_in, 0::BIGINT AS n_dup, {every("count_if(s_{n}) AS n_spike_{n}", SIX)}, {cells}
  any_value(u_um) AS um, any_value(v_um) AS vm, any_value(theta) AS theta, any_value(phi) AS phi, any_value(lc) AS lc, any_value(bc) AS bc, any_value(lh) AS lh, any_value(bh) AS bh,
  {every("avg(t_{n}) AS {n}_mean", QUANTITIES)}, avg(co2) AS co2m, avg(h2o) AS h2om, {every("var_samp({n}) AS var_{n}", ("u", "v", "w", "ts"))},
  {", ".join(f"covar_samp({a}, {b}) AS cov_{a}_{b}" for a, b in covs)}, {runs} FROM th GROUP BY period_end_us),
p2 AS (SELECT *, sqrt(um * um + vm * vm) AS wind_speed, (180e0 - degrees(atan2(vm, um)) + 720e0) % 360e0 AS wind_dir, pow(cov_u_w * cov_u_w + cov_v_w * cov_v_w, 0.25e0) AS ustar,
  1e6 * co2m {scale} AS co2_dry_ppm, 1e3 * h2om {scale} AS h2o_dry_ppt, {f} AS f_co2, cov_w_co2 * ({f}) AS fc_l0, cov_w_h2o * ({f}) AS fh2o_l0, cov_w_h2o * ({f}) * {K.MV} AS e_l0,
  cov_w_h2o * ({f}) * {K.MV} * lambda_v_mean AS le_l0, cov_w_ts * rho_m_mean * cp_mean AS h_l0, ts_mean * pow(1e5 / p_air_mean, 0.286e0) AS theta_s,
  100e0 * abs((list_avg([c0, c1, c2, c3, c4]) - cov_w_co2) / cov_w_co2) AS sst_pct FROM p1),
p3 AS (SELECT *, (h_l0 - 0.51e0 * cp_mean * ta_mean * e_l0) / (1e0 + 0.51e0 * q_mean) AS h, -(theta_s * pow(ustar, 3e0)) / (0.4e0 * 9.81e0 * cov_w_ts) AS mo_length,
  {z!r}::DOUBLE / (-(theta_s * pow(ustar, 3e0)) / (0.4e0 * 9.81e0 * cov_w_ts)) AS z_l, CASE WHEN sst_pct <= 30 THEN 0 WHEN sst_pct <= 100 THEN 1 ELSE 2 END AS sst_flag FROM p2),
p4 AS (SELECT *, {w} FROM {ws}),
p5 AS (SELECT *, {s}, CASE WHEN z_l < -0.2 THEN 1.3e0 * pow(1e0 - 2e0 * least(z_l, 0e0), 1e0 / 3e0) ELSE 0.21e0 * ln({cor!r}::DOUBLE / ustar) + 3.1e0 END AS sw,
  CASE WHEN z_l < -0.2 THEN 4.15e0 * pow(abs(z_l), 0.125e0) ELSE 0.44e0 * ln({cor!r}::DOUBLE / ustar) + 6.3e0 END AS su,
  CASE WHEN z_l < -1 THEN pow(abs(z_l), -1e0 / 3e0) WHEN z_l < -0.0625 THEN pow(abs(z_l), -0.25e0) WHEN z_l < 0.02 THEN 0.5e0 * pow(abs(z_l), -0.5e0) ELSE 1.4e0 * pow(abs(z_l), -0.25e0) END AS st FROM p4),
pr AS (SELECT *, {s2}, abs((sw - sqrt(var_w) / ustar) / sw) AS itc_w, abs((su - sqrt(var_u) / ustar) / su) AS itc_u, abs((st - sqrt(var_ts) / abs(cov_w_ts / ustar)) / st) AS itc_t,
  make_timestamp(period_end_us - {DAY}) AS period_start, make_timestamp(period_end_us) AS period_end, lc * 1e0 AS co2_lag, bc * 1e0 AS co2_lag_opt, abs(bc) = 8 AS co2_lag_default_used,
  lh * 1e0 AS h2o_lag, bh * 1e0 AS h2o_lag_opt, abs(bh) = 8 AS h2o_lag_default_used FROM p5)"""


def table() -> str:
    out = []
    for name, source, _ in COLUMNS:
        if source in TIMESTAMPS:
            out.append(f"{source} AS {name}")
        elif source in FLAGS:
            out.append(f"{source}::INT AS {name}")
        elif source.startswith("n_") and source != "n_d_mean" or source == "sst_flag":
            out.append(f"{source} AS {name}")
        else:
            f, d = DIGITS.get(source, (1, 6))
            own = SCALE.get(source, 1.0)
            out.append(f"round(({source}) * {float(own)!r}::DOUBLE * {float(f) / own!r}::DOUBLE, {d}) AS {name}")
    return ", ".join(out)


def w(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


_CUT = f"SELECT {P}, {P} - {DAY} AS period_start_us, count(*) AS n_in, min(key_us) AS first_us, max(key_us) AS last_us FROM smp GROUP BY {P}"
_TEXT = "CASE event_id % 8 WHEN 0 THEN '-9999' WHEN 1 THEN ' NAN ' WHEN 2 THEN '' WHEN 3 THEN '1_0' WHEN 4 THEN '1.0d' WHEN 5 THEN '2.5e1' ELSE ' ' || round(value, 2)::DECIMAL(10,2)::VARCHAR END"
_SEC = "epoch_us(date_trunc('second', ts))"

ORACLES: dict[str, str] = {
    "period_cut_right": w(chain(), _CUT),
    "period_cut_left": w(chain(closed="left"), _CUT),
    "monotone_dedupe": w(
        chain(),
        f"""SELECT {P}, count_if(k) AS n_in, count_if(NOT k) AS n_dup, sum(event_id) FILTER (WHERE k)::BIGINT AS sum_id FROM (
  SELECT *, coalesce(key_us > max(key_us) OVER ({B} ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS k FROM (
    SELECT event_id, key_us, {P}, event_id * 2 + CASE WHEN event_id % 7 = 3 THEN 7 ELSE 0 END AS place FROM smp
    UNION ALL SELECT event_id, key_us, {P}, event_id * 2 + 1 FROM smp WHERE event_id % 11 = 5)) GROUP BY {P}""",
    ),
    "min_samples_filter": w(chain(), f"SELECT {P}, count(*) AS n_in FROM smp GROUP BY {P} HAVING count(*) >= 340"),
    "absent_column_fill": w(chain(), f"SELECT {P}, 0::BIGINT AS n_v, count(*) AS n_p, round(avg(98765e0), 6) AS p_mean FROM smp GROUP BY {P}"),
    "unit_affine": f"SELECT event_id, round(value + 273.15e0, 9) AS ts, round(value * 100e0, 9) AS p_air, round(value * (1e-6 / {K.MCO2}) * 1e3, 9) AS co2, round(value * (1e-3 / {K.MV}), 9) AS h2o FROM events",
    "na_token_parse": f"""SELECT event_id, CASE WHEN NOT m AND ok THEN try_cast(t AS DOUBLE) END AS parsed, NOT m AND NOT ok AS refused FROM (
  SELECT *, t IN ('-9999', 'NAN', 'NaN', 'nan', '') AS m, regexp_full_match(t, '[+-]?[0-9]+([.][0-9]*)?(e[+-]?[0-9]+)?') AS ok FROM (SELECT event_id, trim({_TEXT}) AS t FROM events))""",
    "timestamp_iso_parse": f"SELECT event_id, epoch_us(ts) AS key_us, {_SEC} + 50000 AS short_us, true AS refused FROM events",
    "timestamp_numeric_parse": f"SELECT event_id, epoch_us(ts) AS key_us, {_SEC} + 50000 AS short_us, true AS refused FROM events",
    "finite_counts": w(chain(), f"SELECT {P}, count(u) AS n_u, count(h2o) AS n_h2o, count(ta) AS n_ta FROM smp GROUP BY {P}"),
    "nan_means": w(chain(), f"SELECT {P}, {', '.join(r(f'avg({n})', f'{n}_mean') for n in (*SIX, 'ta', 'p_air'))} FROM smp GROUP BY {P}"),
    "medians": w(chain(), f"SELECT {P}, {', '.join(r(f'median({n})', f'{n}_med') for n in SIX)} FROM smp GROUP BY {P}"),
    "mad": w(chain(), f"SELECT {P}, {', '.join(r(f'any_value(d_{n})', f'{n}_mad') for n in SIX)} FROM mads GROUP BY {P}"),
    "variances": w(chain(), f"SELECT {P}, {', '.join(r(f'var_samp({n})', f'var_{n}') for n in ('u', 'v', 'w', 'ts'))} FROM smp GROUP BY {P}"),
    "covariances": w(chain(), f"SELECT {P}, {', '.join(r(f'covar_samp({a}, {b})', f'cov_{a}_{b}') for a, b in (('u', 'v'), ('u', 'w'), ('v', 'w'), ('w', 'ts'), ('w', 'co2'), ('w', 'h2o')))} FROM smp GROUP BY {P}"),
    "joint_counts": w(chain(), f"SELECT {P}, count(w + h2o) AS n_w_h2o, count(ta + h2o) AS n_ta_h2o FROM smp GROUP BY {P}"),
    "friction_velocity": w(chain(), f"SELECT {P}, {r('pow(covar_samp(u, w) * covar_samp(u, w) + covar_samp(v, w) * covar_samp(v, w), 0.25e0)', 'ustar')} FROM smp GROUP BY {P}"),
    "despike_counts": w(chain(), f"SELECT {P}, {every('count_if(s_{n}) AS n_spike_{n}', SIX)} FROM d GROUP BY {P}"),
    "despike_series": w(chain(), "SELECT event_id, round(u, 9) AS u, round(co2 * 1e6, 6) AS co2 FROM d"),
    "despike_trailing_run": w(
        chain(),
        f"""SELECT {P}, count_if(f AND i < l) AS n_spike_u, count_if(x = 50e0 AND NOT (f AND i < l)) AS n_left FROM (
  SELECT *, coalesce(max(i) FILTER (WHERE NOT f) OVER ({B}), -1) AS l FROM (SELECT *, x < m - (7e0 * q) / 0.6745e0 OR x > m + (7e0 * q) / 0.6745e0 AS f FROM (
    SELECT *, median(abs(x - m)) OVER ({B}) AS q FROM (SELECT *, median(x) OVER ({B}) AS m FROM (
      SELECT {P}, i, CASE WHEN i >= n_in - (1 + ({P} // 86400000000) % 3) THEN 50e0 ELSE u END AS x FROM smp))))) GROUP BY {P}""",
    ),
    "wind_vector": w(chain(), f"SELECT {P}, {r('sqrt(avg(u) * avg(u) + avg(v) * avg(v))', 'wind_speed')}, {r('(180e0 - degrees(atan2(avg(v), avg(u))) + 720e0) % 360e0', 'wind_dir')} FROM smp GROUP BY {P}"),
    "double_rotation": w(
        chain().replace("mean AS (SELECT *,", "mean AS (SELECT *,").replace(" FROM d),\nr1", " FROM smp),\nr1"),
        f"SELECT {P}, {r('any_value(theta)', 'theta')}, {r('any_value(phi)', 'phi')}, {', '.join(r(f'var_samp({n})', f'var_{n}') for n in 'uvw')} FROM r2 GROUP BY {P}",
    ),
    "lag_curve_co2": w(chain(), f"SELECT {P}, lag, n, {r('cov', 'cov')} FROM curve"),
    "lag_select": w(chain(), f"SELECT {P}, lc AS applied, bc AS best, abs(bc) = 8 AS default_used, {r('covc', 'cov')} FROM sel2"),
    "lag_shift": w(chain(), "SELECT event_id, lc AS co2_lag_samples, round(co2 * 1e6, 6) AS co2 FROM sh"),
    "linear_detrend": w(
        chain(),
        f"""SELECT {P}, {r("any_value(tm)", "ts_mean")}, {r("var_samp(ts - (ts_s * i + ts_o))", "var_ts")}, {r("covar_samp(w - (w_s * i + w_o), h2o - (h2o_s * i + h2o_o))", "cov_w_h2o")}, {r("abs(avg(u - (u_s * i + u_o)))", "u_left")} FROM (
  SELECT *, avg(ts) OVER ({B}) AS tm, {every("regr_slope({n}, i) OVER (" + B + ") AS {n}_s, regr_intercept({n}, i) OVER (" + B + ") AS {n}_o", ("u", "w", "ts", "h2o"))} FROM smp) GROUP BY {P}""",
    ),
    "cell_conversion": w(chain(cell=True), f"SELECT {P}, count(cell_factor) AS n_cell_converted, {', '.join(r(f'avg({n})', f'{n}_mean') for n in ('t_cell', 'p_cell', 'v_cell', 'chi_h2o_cell', 'co2', 'h2o'))} FROM cx GROUP BY {P}"),
    "thermo_state": w(chain() + thermo("smp", False), f"SELECT {P}, count(ta) AS n_ta_source_measured, {', '.join(r(f'avg(t_{q})', f'{q}_mean') for q in QUANTITIES)} FROM th GROUP BY {P}"),
    "thermo_density": w(chain(density=True) + thermo("smp", True), f"SELECT {P}, {', '.join(r(f'avg(t_{q})', f'{q}_mean') for q in QUANTITIES)} FROM th GROUP BY {P}"),
    "thermo_scalars": f"""SELECT event_id, {r("exp(77.345e0 + 0.0057e0 * t - 7235e0 / t) / pow(t, 8.2e0)", "es")}, {r("1005e0 + (t - 273.15e0 + 23.12e0) * (t - 273.15e0 + 23.12e0) / 3364e0", "cp_d")},
  {r("1859e0 + 0.13e0 * rh + (0.193e0 + 5.6e-3 * rh) * (t - 273.15e0) + (1e-3 + 5e-5 * rh) * (t - 273.15e0) * (t - 273.15e0)", "cp_v")}, {r("1e3 * (3147.5e0 - 2.37e0 * t)", "lambda_v")},
  {r("t / (1e0 + 0.32e0 * (1500e0 / 99000e0))", "t_air")}, {r("(rh / 1e3) / (1e0 + rh / 1e3)", "moist")} FROM (SELECT event_id, 263.15e0 + value * 0.4931e0 AS t, (event_id % 100)::DOUBLE AS rh FROM events)""",
    "flux_assembly": w(periods(), f"SELECT {P}, {', '.join(r(n, n) for n in ('f_co2', 'fc_l0', 'fh2o_l0', 'e_l0', 'le_l0', 'h_l0', 'h'))} FROM pr"),
    "obukhov": w(periods(), f"SELECT {P}, {', '.join(r(n, n) for n in ('theta_s', 'mo_length', 'z_l'))} FROM pr"),
    "wpl_open_path": w(periods(density=True), f"SELECT {P}, wpl_applied, {', '.join(r(n, n) for n in ('wt', 'fc', 'e', 'le'))} FROM pr"),
    "wpl_off_withheld": w(periods(density=True, wpl="off"), f"SELECT {P}, wpl_applied, {', '.join(r(n, n) for n in ('fc', 'e', 'le', 'fc_l0'))} FROM pr"),
    "spectral_factor": w(periods(spectral=True), f"SELECT {P}, {', '.join(r(n, n) for n in ('scf_co2', 'scf_h2o', 'fc_spec', 'e_spec', 'le_spec'))} FROM pr"),
    "steady_state": w(periods(), f"SELECT {P}, sst_flag, {r('sst_pct', 'sst_pct')} FROM pr"),
    "itc": w(periods(), f"SELECT {P}, {', '.join(r(n, n) for n in ('itc_w', 'itc_u', 'itc_t'))} FROM pr"),
    "flux_table": w(periods(), f"SELECT {table()} FROM pr"),
    "flux_table_closed_path": w(periods(cell=True), f"SELECT {table()} FROM pr"),
    "first_three_periods": w(chain(), f"SELECT {P}, count(*) AS n FROM smp GROUP BY {P} ORDER BY {P} LIMIT 3"),
    "run_summary_short": w(chain(), f"SELECT count(*) FILTER (WHERE n >= 340) AS periods, (sum(n) FILTER (WHERE n >= 340))::BIGINT AS samples, CASE WHEN count(*) FILTER (WHERE n >= 340) > 0 THEN 0::BIGINT END AS duplicates, 0::BIGINT AS warnings, count(*) FILTER (WHERE n < 340) AS skipped_short, sum(n)::BIGINT AS rows FROM (SELECT {P}, count(*) AS n FROM smp GROUP BY {P})"),
    "observed_rate": "WITH e AS (SELECT (event_id % 3)::VARCHAR AS file, event_id, epoch_us(ts) AS k FROM events), g AS (SELECT file, count(*) AS n, arg_min(k, event_id) AS a, arg_max(k, event_id) AS b FROM e GROUP BY file) SELECT file, n, round((n - 1) * 1000000.0::DOUBLE / (b - a), 12) AS rate, abs((n - 1) * 1000000.0::DOUBLE / (b - a) - 0.0013::DOUBLE) > 0.01::DOUBLE * 0.0013::DOUBLE AS off FROM g",
    "failed_step_rows": w(chain(), f"SELECT {P}, count(*) AS n, CASE WHEN {P} // 86400000000 % 2 = 0 THEN count(*) * 2.0::DOUBLE END AS twice FROM smp GROUP BY {P}"),
    "csv_cells": w(chain(), f"SELECT strftime(make_timestamp({P} - 86400000000), '%Y%m%d%H%M') AS timestamp_start, strftime(make_timestamp({P}), '%Y%m%d%H%M') AS timestamp_end, count(*)::VARCHAR AS n_in, '-9999' AS scf_co2, 62::BIGINT AS n_units FROM smp GROUP BY {P}"),
    "run_summary": w(periods(spectral=True), "SELECT count(*) AS periods, sum(n_in)::BIGINT AS samples, 0::BIGINT AS duplicates, count_if(scf_co2 > 2 OR scf_h2o > 2) AS warnings FROM pr"),
    "flux_table_native": w(periods(), f"SELECT {table()} FROM pr"),
    "lag_shift_native": w(chain(), "SELECT event_id, lc AS co2_lag_samples, round(co2 * 1e6, 6) AS co2 FROM sh"),
    "late_samples": w(
        chain(),
        f"""SELECT event_id, (event_id % 3)::INT AS file_rank, {P} FROM (SELECT *, max({P}) OVER (ORDER BY event_id % 3, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM smp) WHERE {P} < seen""",
    ),
    "sample_times": w(chain(), f"SELECT event_id, i, make_timestamp({P} - {DAY} + i * 1000000) AS time FROM smp"),
    "rotation_check": w(chain(), f"SELECT {P}, true AS v_ok, true AS w_ok FROM smp GROUP BY {P}"),
    "ieee_division": "SELECT event_id, CASE WHEN b = 0 AND a = 0 THEN 'nan' WHEN b = 0 AND a > 0 THEN 'inf' WHEN b = 0 THEN '-inf' ELSE round(a / b, 6)::DECIMAL(10,6)::VARCHAR END AS q FROM (SELECT event_id, (event_id % 3 - 1)::DOUBLE AS a, (event_id % 5 - 2)::DOUBLE AS b FROM events)",
    "csv_roundtrip": w(chain(), f"SELECT {P}, count(*) AS n_in, 0::BIGINT AS n_dup, round(avg(u), 6) AS u_mean, count(h2o) AS n_h2o FROM smp GROUP BY {P}"),
    "streaming_periods": w(chain(), f"SELECT {P}, count(*) AS n, round(avg(2e0 - 0.56e0 * g), 6) AS u_mean, round(covar_samp(2e0 - 0.56e0 * g, 0.05e0 + 0.7e0 * g), 6) AS cov_u_w FROM e1 GROUP BY {P}"),
}

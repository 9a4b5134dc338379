"""Steps against numpy, on awkward periods; and the two strategies against each other."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from eddyforge.config import SERIES, default
from eddyforge.errors import StepError
from eddyforge.operators import fused as fusing
from eddyforge.operators import lag as L
from eddyforge.operators import samples as S
from eddyforge.plans import PERIOD_STEPS, SAMPLE_STEPS, apply_step, publish, run, user_step
from eddyforge.sources import from_dataframe

CFG = default(site__latitude=48.85, period__acquisition_frequency=10, period__averaging_minutes=1, lag__co2_min_s=-1, lag__co2_max_s=1, lag__h2o_min_s=-1, lag__h2o_max_s=1)


def frame(spark, cfg=CFG, n=600, periods=2, seed=1, **series):
    rng = np.random.default_rng(seed)
    total = n * periods
    w = rng.normal(0, 0.3, total + 40)
    base = {
        "u": 2 + rng.normal(0, 0.5, total), "v": -0.3 + rng.normal(0, 0.4, total), "w": 0.05 + w[20 : total + 20], "ts": 293 + w[20 : total + 20] + rng.normal(0, 0.1, total),
        "co2": 400e-6 + 1e-5 * w[15 : total + 15] + rng.normal(0, 1e-6, total), "h2o": 0.01 + 1e-3 * w[20 : total + 20], "p_air": np.full(total, 99000.0), "ta": 291 + rng.normal(0, 0.1, total),
    }
    base |= series
    step = 1_000_000 // 10
    rows = [(int((i + 1) * step), *[None if x is None or not np.isfinite(x) else float(x) for x in v]) for i, v in enumerate(zip(*base.values()))]
    df = spark.createDataFrame(rows, "key_us long, " + ", ".join(f"{k} double" for k in base))
    return from_dataframe(df, cfg), base


def test_planted_lag_is_found_by_both_strategies(spark):
    df, _ = frame(spark)
    for strategy in ("arrow", "native"):
        got = {r["period_end_us"]: (r["a"], r["b"]) for r in L.apply_lags(S.rotate(df, CFG), CFG, strategy).groupBy("period_end_us").agg(F.first("co2_lag_samples").alias("a"), F.first("h2o_lag_samples").alias("b")).collect()}
        assert set(got.values()) == {(5, 0)}


def test_strategies_agree_on_every_figure(spark):
    df, base = frame(spark)
    spikes = base["u"].copy()
    spikes[[100, 300, 301, 599]] = 60.0
    gaps = base["h2o"].copy()
    gaps[::37] = np.nan
    df, _ = frame(spark, u=spikes, h2o=gaps)
    a = {r["period_end_us"]: r.asDict() for r in run(df, CFG, "arrow").collect()}
    b = {r["period_end_us"]: r.asDict() for r in run(df, CFG, "native").collect()}
    assert a.keys() == b.keys() and len(a) == 2
    for k in a:
        assert set(a[k]) == set(b[k])
        for name, x in a[k].items():
            y = b[k][name]
            assert (x is None) == (y is None), name
            if isinstance(x, float):
                assert x == pytest.approx(y, rel=1e-7, abs=1e-12), name
            else:
                assert x == y, name
    assert sorted(r["n_spike_u"] for r in a.values()) == [0, 3]


@pytest.mark.parametrize("strategy", ["arrow", "native"])
def test_degenerate_periods_give_rows(spark, strategy):
    nan = np.full(1200, np.nan)
    for series in ({"u": nan, "v": nan, "w": nan, "ts": nan, "co2": nan, "h2o": nan, "ta": nan}, {"w": np.full(1200, 0.1), "co2": np.full(1200, 4e-4)}, {"p_air": np.zeros(1200)}):
        df, _ = frame(spark, **series)
        assert publish(run(df, CFG, strategy), CFG).count() == 2
    one, _ = frame(spark, n=1, periods=1)
    assert publish(run(one, CFG, strategy), CFG).count() == 1


def test_despike_arrays():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, 1000)
    y = x.copy()
    y[500] = 50
    assert fusing.despike_array(y, 7) == 1 and np.isnan(y[500])
    y = x.copy()
    y[999] = 50
    assert fusing.despike_array(y, 7) == 0
    assert fusing.despike_array(np.full(10, 3.0), 7) == 0
    z = np.array([1.0, 1, 1, 2, 1, 1])
    assert fusing.despike_array(z, 7) == 1
    assert fusing.despike_array(np.full(5, np.nan), 7) == 0 and fusing.despike_array(np.zeros(0), 7) == 0
    tail = np.array([1.0, 1, 1, 1, 9, np.nan])  # the last row is missing, so the spike before it isn't at the end
    assert fusing.despike_array(tail, 7) == 1


def test_choose_prefers_the_lowest_of_equals():
    w = L.Window(0, 0, 0, 0, -2, 2)
    assert L.choose(np.array([0.1, -0.9, 0.2, 0.9 * (1 + 1e-14), 0.1]), w, "covmax") == (-1, -1, -0.9, False)
    assert L.choose(np.zeros(5), w, "covmax")[0::3] == (0, True)
    assert L.choose(np.full(5, np.nan), w, "covmax")[0::3] == (0, True)
    assert L.choose(np.array([0.9, 0, 0, 0, 0]), w, "covmax_default") == (0, -2, 0.9, True)
    assert L.choose(np.array([0.9, 0, 0, 0, 0]), w, "covmax") == (-2, -2, 0.9, False)


def test_fold_equals_choose(spark):
    w = L.Window(0, 0, 0, 0, -2, 2)
    curves = {1: [0.1, -0.9, 0.2, 0.9 * (1 + 1e-14), 0.1], 2: [0.0] * 5, 3: [None] * 5, 4: [0.9, 0, 0, 0, 0], 5: [None, 0.1, None, -0.3, 0.2]}
    df = spark.createDataFrame([(p, lag, float(c) if c is not None else None, 9) for p, cs in curves.items() for lag, c in zip(range(-2, 3), cs)], "period_end_us long, lag int, cov double, n long")
    for method in ("covmax", "covmax_default"):
        for r in L.find_lag(df, w, method).collect():
            want = L.choose(np.array([np.nan if c is None else c for c in curves[r["period_end_us"]]]), w, method)
            assert (r["applied"], r["best"], r["default_used"]) == (want[0], want[1], want[3])


def test_shift_truncates():
    x = np.arange(5.0)
    assert np.array_equal(L.shift(x, 2), [2, 3, 4, np.nan, np.nan], equal_nan=True)
    assert np.array_equal(L.shift(x, -2), [np.nan, np.nan, 0, 1, 2], equal_nan=True)
    assert np.isnan(L.shift(x, 9)).all()


def test_curve_refuses_a_reversed_window():
    with pytest.raises(ValueError):
        L.curve(np.zeros(3), np.zeros(3), 1, 0)


@pytest.mark.parametrize("method,want", [("none", (0, False)), ("fixed", (2, True))])
def test_static_lags(spark, method, want):
    cfg = default(period__acquisition_frequency=10, period__averaging_minutes=1, lag__method=method, lag__co2_nominal_s=0.2)
    df, base = frame(spark, cfg)
    out = L.apply_lags(df, cfg).where("period_end_us = 60000000").orderBy("i").select("co2", "co2_lag_samples", "co2_lag_default_used").collect()
    assert (out[0]["co2_lag_samples"], out[0]["co2_lag_default_used"]) == want
    assert out[0]["co2"] == base["co2"][want[0]]


def test_unconfigured_window_is_lag_zero(spark):
    cfg = default(period__acquisition_frequency=10, period__averaging_minutes=1, lag__co2_nominal_s=0.5, lag__co2_min_s=0, lag__co2_max_s=0)
    df, _ = frame(spark, cfg)
    r = L.apply_lags(df, cfg).select("co2_lag_samples", "co2_lag_default_used", "co2_lag_cov").first()
    assert tuple(r) == (0, False, None)


def test_one_lag_window_lands_on_the_rim(spark):
    cfg = default(period__acquisition_frequency=10, period__averaging_minutes=1, lag__co2_nominal_s=0.5, lag__co2_min_s=0.2, lag__co2_max_s=0.2)
    df, _ = frame(spark, cfg)
    r = L.apply_lags(df, cfg).select("co2_lag_samples", "co2_lag_opt_samples", "co2_lag_default_used").first()
    assert tuple(r) == (5, 2, True)


def test_rotation_leaves_the_mean_wind_along_u(spark):
    df, _ = frame(spark)
    for r in S.rotation_residuals(S.rotate(df, CFG)).collect():
        assert r["v_residual"] < 1e-9 and r["w_residual"] < 1e-9


def test_linear_detrend_equals_polyfit(spark):
    cfg = default(period__acquisition_frequency=10, period__averaging_minutes=1, detrend__method="linear")
    df, base = frame(spark, cfg)
    got = np.array([r["ts"] for r in S.detrend(df, cfg).where("period_end_us = 60000000").orderBy("i").collect()])
    i = np.arange(600)
    assert got == pytest.approx(base["ts"][:600] - np.polyval(np.polyfit(i, base["ts"][:600], 1), i), abs=1e-8)


def test_closed_path_conversion_recovers_dry_ratios(spark):
    cfg = default(period__acquisition_frequency=10, period__averaging_minutes=1, gases__co2_measure_type="molar_density", gases__h2o_measure_type="molar_density", units__co2="mol/m3", units__h2o="mol/m3", gases__analyser_path="closed", variables__t_cell="a", variables__p_cell="b")
    _, base = frame(spark, cfg)
    t, p = 300 + np.arange(1200) * 1e-3, 95000 + np.arange(1200) * 0.1
    n = p / (8.314462618 * t) / (1 + base["h2o"])
    df, _ = frame(spark, cfg, co2=base["co2"] * n, h2o=base["h2o"] * n, t_cell=t, p_cell=p)
    got = S.convert_cell(df, cfg).orderBy("period_end_us", "i").select("co2", "h2o").collect()
    assert [r["co2"] for r in got] == pytest.approx(list(base["co2"]), rel=1e-10)
    assert [r["h2o"] for r in got] == pytest.approx(list(base["h2o"]), rel=1e-10)


def test_wpl_reference_parcel(spark):
    """A density flux of -20 umol m-2 s-1 in a warm moist parcel becomes -9.386."""
    cfg = default(gases__co2_measure_type="molar_density", gases__h2o_measure_type="mixing_ratio", units__co2="mmol/m3")
    from eddyforge import constants as K

    ta, p, chi = 293.0, 99000.0, 0.012
    rho_v = chi * K.MV * p / (K.R * ta)
    e = rho_v * K.RV * ta
    rho_d = (p - e) / (K.RD * ta)
    rho_m = rho_d + rho_v
    rho_c = 0.000395 * (p - e) / (K.R * ta) * K.MCO2
    row = {"h": 180.0, "rho_m_mean": rho_m, "cp_mean": 1005.0 * (1 - rho_v / rho_m) + 1876.0 * rho_v / rho_m, "rho_v_mean": rho_v, "rho_d_mean": rho_d, "ta_mean": ta, "lambda_v_mean": 1e3 * (3147.5 - 2.37 * ta), "chi_v_mean": chi, "rho_c_mean": rho_c, "fc_l0": -20e-6, "fh2o_l0": 0.004, "e_l0": 0.004 * K.MV, "le_l0": 0.0}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row))
    got = apply_step("wpl", df, cfg).first()
    assert got["wpl_applied"] and -12e-6 < got["fc"] < -7e-6
    gone = apply_step("wpl", df.withColumn("h", F.lit(None).cast("double")), cfg).first()
    assert not gone["wpl_applied"] and gone["fc"] is None and gone["e"] is None


def test_apply_step_refuses_what_it_does_not_know(spark):
    df, _ = frame(spark)
    with pytest.raises(StepError, match="not a step"):
        apply_step("fly", df, CFG)
    with pytest.raises(StepError, match="not double"):
        apply_step("rotate", df.withColumn("u", F.col("u").cast("string")), CFG)
    with pytest.raises(StepError, match="needs the columns"):
        apply_step("rotate", df.drop("v"), CFG)
    assert set(SAMPLE_STEPS) == {"cell", "despike", "rotate", "lag", "thermodynamics", "detrend"} and set(PERIOD_STEPS) == {"assemble", "wpl", "spectral", "qc"}


def test_user_steps_run(spark):
    df, _ = frame(spark)
    extra = run(df, CFG, period_steps=[lambda p, cfg: p.withColumn("bowen", F.col("h") / F.col("le"))])
    assert "bowen" in extra.columns
    step = user_step(lambda x, cfg: {"period_end_us": x["period_end_us"][:1], "top": np.array([x["u"].max()])}, "period_end_us long, top double")
    assert step(df, CFG).count() == 2


def test_a_step_that_raises_leaves_the_row(spark):
    df, _ = frame(spark)

    def fails(x, cfg):
        raise ValueError("made up")

    rows = user_step(fails, "period_end_us long, top double")(df, CFG).collect()
    assert len(rows) == 2 and all(r["top"] is None for r in rows)
    p = run(df, CFG)
    out = publish(run(df, CFG, period_steps=[user_step(fails, p.schema)]), CFG)
    assert sorted(map(str, out.collect())) == sorted(map(str, publish(p, CFG).collect()))


def test_sites_are_kept_apart(spark):
    df, _ = frame(spark)
    raw = df.select("key_us", *SERIES)
    both = raw.withColumn("site", F.lit("a")).unionByName(raw.withColumn("site", F.lit("b")))
    out = publish(run(from_dataframe(both, CFG), CFG), CFG)
    assert out.count() == 4 and out.columns[0] == "site"


@pytest.mark.parametrize(
    "changes",
    [
        {"rotate__method": "none"}, {"detrend__method": "linear"}, {"despike__enabled": "false"}, {"lag__method": "covmax"}, {"lag__method": "none"}, {"wpl__enabled": "on"}, {"wpl__enabled": "off"},
        {"gases__co2_measure_type": "molar_density", "units__co2": "mmol/m3"}, {"gases__h2o_measure_type": "molar_density", "units__h2o": "mol/m3"},
        {"spectral__enabled": "true", "spectral__co2_tau_s": 0.1, "spectral__h2o_tau_s": 0.3}, {"qc__itc": "false"}, {"qc__steady_state_pair": "w,ts"}, {"period__closed": "left"}, {"site__latitude": 0},
    ],
)
def test_configuration_matrix(spark, changes):
    cfg = default(**({"period__acquisition_frequency": 10, "period__averaging_minutes": 1, "site__latitude": 48.85} | changes))
    df, _ = frame(spark, cfg, n=120)
    rows = publish(run(df, cfg), cfg).collect()
    assert rows and len(rows[0]) == 62


def test_lag_curve_moves_no_samples(spark, sf_dir):
    """Pairs meet within their period's task: no join, so nothing of the samples is broadcast or shuffled again."""
    from eddyforge import queries as Q

    plan = Q.lag_curve_co2(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan

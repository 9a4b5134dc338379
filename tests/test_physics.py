"""Check values of the scalar formulas."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from eddyforge import functions as fn


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "column,want,tolerance",
    [
        (lambda: fn.saturation_vapour_pressure(F.lit(293.15)), 2331.215, 1e-3),
        (lambda: fn.cp_dry(F.lit(293.15)), 1005.5527, 1e-4),
        (lambda: fn.cp_vapour(F.lit(293.15), F.lit(50.0)), 1876.36, 1e-2),
        (lambda: fn.latent_heat(F.lit(293.15)), 2452734.5, 1e-1),
        (lambda: fn.spectral_factor(F.lit(-0.5), F.lit(2.0), 0.13, 1.9), 1.1013541, 1e-6),
        (lambda: fn.spectral_factor(F.lit(0.5), F.lit(2.0), 0.13, 1.9), 1.4023884, 1e-6),
        (lambda: fn.wind_direction(F.lit(1.0), F.lit(0.0)), 180.0, 1e-9),
        (lambda: fn.wind_direction(F.lit(0.0), F.lit(1.0)), 90.0, 1e-9),
        (lambda: fn.wind_direction(F.lit(-1.0), F.lit(0.0)), 0.0, 1e-9),
        (lambda: fn.wind_direction(F.lit(1.0), F.lit(0.0), 190.0), 10.0, 1e-9),
    ],
)
def test_golden(spark, column, want, tolerance):
    assert value(spark, column()) == pytest.approx(want, abs=tolerance)


def test_saturation_is_nan_at_zero_kelvin(spark):
    assert math.isnan(value(spark, fn.saturation_vapour_pressure(F.lit(0.0))))
    assert math.isnan(value(spark, fn.saturation_vapour_pressure(F.lit(-3.0))))


@pytest.mark.parametrize("n,d", [(1.0, 2.0), (1.0, 0.0), (-1.0, 0.0), (1.0, -0.0), (0.0, 0.0), (float("nan"), 0.0), (-3.0, -0.0), (float("inf"), 2.0)])
def test_division_is_ieee(spark, n, d):
    import numpy as np

    with np.errstate(all="ignore"):
        want = float(np.float64(n) / np.float64(d))
    df = spark.createDataFrame([(n, d)], "n double, d double")
    for f in (fn.ieee_div, fn.ieee_ratio):
        got = df.select(f(F.col("n"), F.col("d")).alias("q")).first()["q"]
        assert (math.isnan(got) and math.isnan(want)) or got == want


def test_division_of_null_is_null(spark):
    df = spark.createDataFrame([(None, 0.0), (1.0, None)], "n double, d double")
    assert [r["q"] for r in df.select(fn.ieee_div(F.col("n"), F.col("d")).alias("q")).collect()] == [None, None]


@pytest.mark.parametrize("pct,flag", [(0.0, 0), (30.0, 0), (30.0001, 1), (100.0, 1), (100.1, 2), (float("nan"), 2), (None, 2), (float("inf"), 2)])
def test_sst_flag(spark, pct, flag):
    assert value(spark, fn.sst_flag(F.lit(pct).cast("double"))) == flag


def test_fin_takes_out_what_is_not_finite(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "x double")
    assert [r["y"] for r in df.select(fn.fin(F.col("x")).alias("y")).collect()] == [1.0, None, None, None, None]

"""Aggregate building blocks over columns that may be NULL; NULL is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import fin


def within(x: Column, i: Column, start: Column | int, stop: Column | int) -> Column:
    """x where start <= i < stop."""
    return F.when((i >= start) & (i < stop), x)


def count_finite(x: Column) -> Column:
    return F.count(fin(x))


def nansum(x: Column) -> Column:
    return F.sum(fin(x))


def nanmean(x: Column) -> Column:
    return F.avg(fin(x))


def nanmedian(x: Column) -> Column:
    """Exact; the mean of the middle two for an even count."""
    return F.median(fin(x))


def deviation(x: Column, median: Column) -> Column:
    """|x - median|, whose median is the MAD."""
    return F.abs(x - median)


def covariance(x: Column, y: Column) -> Column:
    """Over rows where both are there, ddof 1; NULL for fewer than two."""
    return F.covar_samp(fin(x), fin(y))


def variance(x: Column) -> Column:
    return F.var_samp(fin(x))


def spike_bounds(median: Column, mad: Column, q: float) -> tuple[Column, Column]:
    half = (F.lit(float(q)) * mad) / F.lit(K.MAD_SCALE)
    return median - half, median + half


def spike_flag(x: Column, low: Column, high: Column) -> Column:
    """Strictly outside the bounds; NULL is never a spike."""
    return F.coalesce((x < low) | (x > high), F.lit(False))


def slope(x: Column, i: Column) -> Column:
    """Least-squares slope on the original index; 0 for fewer than three points."""
    return F.when(F.count(x) < 3, F.when(F.count(x) > 0, F.lit(0.0))).otherwise(F.regr_slope(x, i))


def intercept(x: Column, i: Column) -> Column:
    return F.when(F.count(x) < 3, F.avg(x)).otherwise(F.regr_intercept(x, i))


def pairs(x: Column, y: Column) -> Column:
    """Number of rows where both are there."""
    return F.count(F.when(x.isNotNull() & y.isNotNull(), 1))

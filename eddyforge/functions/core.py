"""Missing data is NULL inside the engine; these are the gates at its borders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
NAN = float("nan")


def finite(x: Column) -> Column:
    """Whether a value is there and neither NaN nor infinite (NaN sorts above infinity)."""
    return F.coalesce(F.abs(x) < F.lit(INF), F.lit(False))


def fin(x: Column) -> Column:
    """The value, or NULL for NaN and infinities: aggregates skip NULL but are poisoned by NaN."""
    return F.when(F.abs(x) < F.lit(INF), x)


def joint(*xs: Column) -> Column:
    """Whether all values are finite."""
    out = finite(xs[0])
    for x in xs[1:]:
        out = out & finite(x)
    return out


def ieee_ratio(n: Column, d: Column) -> Column:
    """``ieee_div`` by the reciprocal: good to the last bit but one, and each operand stands once, so
    long chains of it stay small enough to be compiled. For figures per sample."""
    return n * F.pow(d, F.lit(-1.0))


def ieee_div(n: Column, d: Column) -> Column:
    """Division that never raises: n/0 is a signed infinity, 0/0 and NaN/0 are NaN, NULL stays NULL."""
    # The sign of a zero shows only in its text.
    far = F.signum(n) * F.lit(INF) * F.when(d.cast("string") == "-0.0", -1.0).otherwise(1.0)
    zero = F.when((n == 0) | F.isnan(n), F.lit(NAN)).otherwise(far)
    return F.when(d == 0, F.when(n.isNotNull(), zero)).otherwise(n / F.when(d == 0, F.lit(None)).otherwise(d))


def ieee_pow(x: Column, y: float) -> Column:
    """Power that is NaN for a negative base."""
    return F.when(x < 0, F.lit(NAN)).otherwise(F.pow(x, F.lit(float(y))))

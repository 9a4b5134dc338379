"""Time lag: covariance curve, search, and shift of scalars against the vertical wind.

Two strategies give the same figures:

* ``arrow`` (default): a period's arrays go to one numpy function, which scans the lags and shifts
  the scalar in place. A row is moved once however wide the window is.
* ``native``: a window over the index gathers each sample's lagged partners, and the curve is folded
  in order of lag by a higher-order aggregate; the shift is a regrouping by the target index. It makes
  rows times lags within a task, so it is for narrow windows or where Python workers are not wanted.

Neither shuffles: the frame is already partitioned by period.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config, Window
from ..constants import TIE_MARGIN
from .common import INDEX, keys, need, over

FIELDS = (("lag", "double"), ("lag_opt", "double"), ("lag_samples", "long"), ("lag_opt_samples", "long"), ("lag_cov", "double"), ("lag_default_used", "boolean"))


def curve(w: np.ndarray, c: np.ndarray, low: int, high: int) -> np.ndarray:
    """Covariance of w[i] and c[i + L] for L = low..high over finite pairs; NaN for fewer than two."""
    if high < low:
        raise ValueError("the last lag is before the first")
    n, out = len(w), np.full(high - low + 1, np.nan)
    gw, gc = np.isfinite(w), np.isfinite(c)
    w0, c0 = np.where(gw, w, 0.0), np.where(gc, c, 0.0)
    full = gw.all() and gc.all()
    fw, fc = gw.astype(np.float64), gc.astype(np.float64)
    for k, lag in enumerate(range(low, high + 1)):
        if abs(lag) >= n:
            continue
        a, b = (slice(0, n - lag), slice(lag, n)) if lag >= 0 else (slice(-lag, n), slice(0, n + lag))
        x, y = w0[a], c0[b]
        if full:
            m, sx, sy = float(len(x)), x.sum(), y.sum()
        else:
            m, sx, sy = float(fw[a] @ fc[b]), float(x @ fc[b]), float(fw[a] @ y)
        if m >= 2:
            out[k] = (float(x @ y) - sx * sy / m) / (m - 1)
    return out


def choose(covs: np.ndarray, window: Window, method: str) -> tuple[int, int, float, bool]:
    """(applied, best, covariance at best, default used) from a curve in ascending order of lag.

    A lag wins only if its |covariance| exceeds the best so far by the tie margin, so of equals the
    lowest lag stays. With ``covmax_default`` a best lag on the rim gives way to the nominal one.
    """
    top, best, cov = 0.0, None, np.nan
    for k, x in enumerate(covs):
        if np.isfinite(x) and abs(x) > top * TIE_MARGIN:
            top, best, cov = abs(x), window.low + k, float(x)
    if best is None:
        return window.nominal, window.nominal, np.nan, True
    if method == "covmax_default" and best in (window.low, window.high):
        return window.nominal, best, cov, True
    return best, best, cov, False


def shift(x: np.ndarray, lag: int) -> np.ndarray:
    """x[i + lag], NaN off the end; never wraps."""
    out = np.full(len(x), np.nan)
    n = len(x)
    if abs(lag) < n:
        if lag >= 0:
            out[: n - lag] = x[lag:]
        else:
            out[-lag:] = x[: n + lag]
    return out


def static_choice(cfg: Config, scalar: str) -> tuple[int, int, bool] | None:
    """(applied, best, default used) where no search is made, else None."""
    window = cfg.lags[scalar]
    if cfg.lag.method == "none":
        return 0, 0, False
    if cfg.lag.method == "fixed":
        return window.nominal, window.nominal, True
    if not window.configured:
        return 0, 0, False
    return None


def apply_lags(df: DataFrame, cfg: Config, strategy: str = "arrow") -> DataFrame:
    """Shifts each scalar by its lag; w never moves. Adds six columns <scalar>_lag... per scalar."""
    scalars = [s for s in cfg.lag.scalars if s in df.columns]
    need(df, "apply_lags", "w")
    if strategy not in ("arrow", "native"):
        raise ValueError("strategy is 'arrow' or 'native'")
    searched = [s for s in scalars if static_choice(cfg, s) is None]
    for s in scalars:
        if (fixed := static_choice(cfg, s)) is not None:
            df = _static(df, cfg, s, *fixed)
    if not searched:
        return df
    return _arrow(df, cfg, searched) if strategy == "arrow" else _native(df, cfg, searched)


def _static(df: DataFrame, cfg: Config, s: str, applied: int, best: int, used: bool) -> DataFrame:
    from pyspark.sql import Window as W

    f = cfg.period.acquisition_frequency
    if applied:
        by = W.partitionBy(*keys(df)).orderBy(INDEX)
        df = df.withColumn(s, (F.lead(s, applied) if applied > 0 else F.lag(s, -applied)).over(by))
    values = (applied / f, best / f, applied, best, None, used)
    return df.withColumns({f"{s}_{n}": F.lit(v).cast(k) for (n, k), v in zip(FIELDS, values)})


def _arrow(df: DataFrame, cfg: Config, scalars: list[str]) -> DataFrame:
    schema = T.StructType(list(df.schema.fields))
    for s in scalars:
        for n, k in FIELDS:
            schema = schema.add(f"{s}_{n}", k)
    names, by, f, method = schema.names, keys(df), cfg.period.acquisition_frequency, cfg.lag.method
    windows = {s: cfg.lags[s] for s in scalars}
    kinds = {"double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_()}

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(INDEX)
        n = table.num_rows
        w = _array(table, "w")
        w = w - _mean(w)
        columns = {c: table.column(c) for c in table.column_names}
        for s, window in windows.items():
            c = _array(table, s)
            applied, best, cov, used = choose(curve(w, c - _mean(c), window.low, window.high), window, method)
            columns[s] = pa.array(shift(c, applied), from_pandas=True)
            values = (applied / f, best / f, applied, best, None if np.isnan(cov) else cov, used)
            columns |= {f"{s}_{name}": pa.array([v] * n, kinds[k]) for (name, k), v in zip(FIELDS, values)}
        return pa.table([columns[c] for c in names], names=names)

    return df.groupBy(*by).applyInArrow(run, schema)


def _array(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy(zero_copy_only=False).astype(np.float64)


def _mean(x: np.ndarray) -> float:
    good = x[np.isfinite(x)]
    return float(good.mean()) if len(good) else np.nan


def lag_curve(df: DataFrame, scalar: str, low: int, high: int) -> DataFrame:
    """(period, lag, cov, n): the curve of pre-centred pairs (i, i + lag) of a period.

    A window gathers the partners: it moves no row, where a join would broadcast or shuffle rows times lags.
    """
    from pyspark.sql import Window as W

    by = keys(df)
    wm, cm = over(df, F.avg("w"), F.avg(scalar))
    centred = df.select(*by, INDEX, (F.col("w") - wm).alias("a"), (F.col(scalar) - cm).alias("b"))
    partner = F.when(F.col("b").isNotNull(), F.struct(F.col(INDEX).alias("j"), "b"))
    near = F.collect_list(partner).over(W.partitionBy(*by).orderBy(INDEX).rangeBetween(low, high))
    met = centred.withColumn("near", near).where("a is not null").select(*by, INDEX, "a", F.explode("near").alias("y"))
    met = met.select(*by, (F.col("y.j") - F.col(INDEX)).cast("int").alias("lag"), "a", F.col("y.b").alias("b"))
    k = F.count(F.lit(1))
    cov = F.when(k >= 2, (F.sum(F.col("a") * F.col("b")) - F.sum("a") * F.sum("b") / k) / F.greatest(k - 1, F.lit(1)))
    return met.groupBy(*by, "lag").agg(cov.alias("cov"), k.alias("n"))


def find_lag(curves: DataFrame, window: Window, method: str) -> DataFrame:
    """One row per period from ``lag_curve``: applied, best, cov, default_used."""
    by = [c for c in curves.columns if c not in ("lag", "cov", "n")]
    points = F.sort_array(F.collect_list(F.struct("lag", "cov")))
    start = F.struct(F.lit(0.0).alias("top"), F.lit(None).cast("int").alias("best"), F.lit(None).cast("double").alias("cov"))

    def step(a: Column, x: Column) -> Column:
        wins = F.coalesce(F.abs(x["cov"]) > a["top"] * F.lit(TIE_MARGIN), F.lit(False))
        return F.when(wins, F.struct(F.abs(x["cov"]).alias("top"), x["lag"].alias("best"), x["cov"].alias("cov"))).otherwise(a)

    g = curves.groupBy(*by).agg(points.alias("points")).withColumn("found", F.aggregate("points", start, step))
    best = F.col("found.best")
    rim = F.lit(method == "covmax_default") & best.isin(window.low, window.high)
    lost = best.isNull() | rim
    nominal = F.lit(window.nominal)
    return g.select(*by, F.when(lost, nominal).otherwise(best).alias("applied"), F.coalesce(best, nominal).alias("best"), F.col("found.cov").alias("cov"), lost.alias("default_used"))


def _native(df: DataFrame, cfg: Config, scalars: list[str]) -> DataFrame:
    by, f, out = keys(df), cfg.period.acquisition_frequency, df
    for s in scalars:  # every curve is of the frame as it came, so the plan grows by one branch each
        window = cfg.lags[s]
        found = find_lag(lag_curve(df, s, window.low, window.high), window, cfg.lag.method)
        found = found.select(*by, (F.col("applied") / f).alias(f"{s}_lag"), (F.col("best") / f).alias(f"{s}_lag_opt"), F.col("applied").cast("long").alias(f"{s}_lag_samples"), F.col("best").cast("long").alias(f"{s}_lag_opt_samples"), F.col("cov").alias(f"{s}_lag_cov"), F.col("default_used").alias(f"{s}_lag_default_used"))
        none = {f"{s}_lag": window.nominal / f, f"{s}_lag_opt": window.nominal / f, f"{s}_lag_samples": window.nominal, f"{s}_lag_opt_samples": window.nominal, f"{s}_lag_default_used": True}
        out = out.join(found, by, "left").withColumns({n: F.coalesce(F.col(n), F.lit(v)) for n, v in none.items()})
    return shift_by(out, {s: f"{s}_lag_samples" for s in scalars})


def shift_by(df: DataFrame, lags: dict[str, str]) -> DataFrame:
    """Each scalar as scalar[i + lag], with a column's lag that differs by period; missing off the end.

    A regrouping by target index in place of a self-join for each scalar: every row goes to its own
    index with all but the scalars, and to the index that each scalar's lag points at with that one.
    """
    by, names = keys(df), list(lags)
    targets = [F.struct(F.col(INDEX).alias("to"), F.lit(-1).alias("of"))]
    targets += [F.struct((F.col(INDEX) - F.col(lags[s])).cast("long").alias("to"), F.lit(k).alias("of")) for k, s in enumerate(names)]
    sent = df.select("*", F.explode(F.array(*targets)).alias("__t"))
    own = F.col("__t.of") == -1
    rest = [c for c in df.columns if c not in by and c not in names and c != INDEX]
    g = sent.groupBy(*by, F.col("__t.to").alias("__to")).agg(
        *[F.max(F.when(own, F.col(c))).alias(c) for c in rest],
        *[F.max(F.when(F.col("__t.of") == k, F.col(s))).alias(s) for k, s in enumerate(names)],
        F.count_if(own).alias("__own"),
    )
    return g.where("__own > 0").withColumnRenamed("__to", INDEX).select(*df.columns)

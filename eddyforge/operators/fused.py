"""Despiking, rotation and the lag search of a period in one numpy pass.

The lag scan needs a period's arrays in any case (as a join it makes rows times lags), and exact
medians are far cheaper on arrays than as aggregates over hash maps of values; so by default the
three steps share one grouped Arrow transfer. The window-function steps in ``samples`` and the
``native`` strategy in ``lag`` give the same figures and stay as the reference for it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .. import constants as K
from ..config import Config
from .common import INDEX, keys, need
from .lag import FIELDS, choose, curve, shift, static_choice

ROTATION = ("u_unrot_mean", "v_unrot_mean", "w_unrot_mean", "wind_speed", "wind_dir", "theta", "phi")


def despike_array(x: np.ndarray, q: float) -> int:
    """NaN in place where x is a spike; the number of spikes."""
    good = np.isfinite(x)
    values = x[good]
    if not len(values):
        return 0
    m = np.median(values)
    half = (q * np.median(np.abs(values - m))) / K.MAD_SCALE
    flag = good & ((x < m - half) | (x > m + half))
    kept = np.flatnonzero(~flag)
    flag[(kept[-1] if len(kept) else -1) + 1 :] = False  # a run that reaches the end stays
    x[flag] = np.nan
    return int(flag.sum())


def mean(x: np.ndarray) -> float:
    good = x[np.isfinite(x)]
    return float(good.mean()) if len(good) else np.nan


def rotate_arrays(u: np.ndarray, v: np.ndarray, w: np.ndarray, method: str, north: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, float]]:
    um, vm, wm = mean(u), mean(v), mean(w)
    out = {"u_unrot_mean": um, "v_unrot_mean": vm, "w_unrot_mean": wm, "wind_speed": float(np.hypot(um, vm)), "wind_dir": float(np.mod(180.0 - np.degrees(np.arctan2(vm, um)) + north, 360.0)), "theta": 0.0, "phi": 0.0}
    if method == "double":
        theta = float(np.arctan2(vm, um))
        u, v = u * np.cos(theta) + v * np.sin(theta), -u * np.sin(theta) + v * np.cos(theta)
        phi = float(np.arctan2(wm, mean(u)))
        u, w = u * np.cos(phi) + w * np.sin(phi), -u * np.sin(phi) + w * np.cos(phi)
        out |= {"theta": theta, "phi": phi}
    return u, v, w, out


def fused(df: DataFrame, cfg: Config) -> DataFrame:
    """What ``despike``, ``rotate`` and ``apply_lags`` do one after the other, same columns; a figure
    of the period stands on its first sample and is NULL on the others, so that it is moved once."""
    need(df, "fused", "u", "v", "w")
    spiky = [n for n in cfg.despike.variables if n in df.columns]
    scalars = [s for s in cfg.lag.scalars if s in df.columns]
    schema = T.StructType(list(df.schema.fields))
    for n in spiky:
        schema = schema.add(f"n_spike_{n}", "long")
    for n in ROTATION:
        schema = schema.add(n, "double")
    for s in scalars:
        for n, k in FIELDS:
            schema = schema.add(f"{s}_{n}", k)
    kinds = {f.name: {"double": pa.float64(), "bigint": pa.int64(), "boolean": pa.bool_()}.get(f.dataType.simpleString()) for f in schema.fields}
    names, q, on, f = schema.names, cfg.despike.q, cfg.despike.enabled, cfg.period.acquisition_frequency
    method, north, search = cfg.rotate.method, cfg.site.north_offset, cfg.lag.method
    fixed = {s: static_choice(cfg, s) for s in scalars}
    windows = {s: cfg.lags[s] for s in scalars}
    series = sorted({*spiky, *scalars, "u", "v", "w"})

    def run(table: pa.Table) -> pa.Table:
        index = table.column(INDEX).to_numpy()
        if (np.diff(index) < 0).any():
            table = table.take(np.argsort(index))
        n = table.num_rows
        x = {s: table.column(s).to_numpy(zero_copy_only=False).astype(np.float64) for s in series}
        figures: dict[str, object] = {}
        for s in spiky:
            figures[f"n_spike_{s}"] = despike_array(x[s], q) if on else 0
        x["u"], x["v"], x["w"], got = rotate_arrays(x["u"], x["v"], x["w"], method, north)
        figures |= got
        centred = x["w"] - mean(x["w"])
        for s in scalars:
            if fixed[s] is None:
                applied, best, cov, used = choose(curve(centred, x[s] - mean(x[s]), windows[s].low, windows[s].high), windows[s], search)
            else:
                (applied, best, used), cov = fixed[s], np.nan
            x[s] = shift(x[s], applied)
            figures |= {f"{s}_{name}": v for (name, _), v in zip(FIELDS, (applied / f, best / f, applied, best, cov, used))}
        columns = {c: table.column(c) for c in table.column_names} | {s: pa.array(v, mask=~np.isfinite(v)) for s, v in x.items()}
        for name, v in figures.items():
            missing = isinstance(v, float) and not np.isfinite(v)
            columns[name] = pa.concat_arrays([pa.array([None if missing else v], kinds[name]), pa.nulls(n - 1, kinds[name])])
        return pa.table([columns[c] for c in names], names=names)

    return df.groupBy(*keys(df)).applyInArrow(run, schema)

"""Frames of one's own in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import SERIES, Config
from ..errors import ReadError
from ..functions import fin
from ..plans.cut import cut_periods

UNITS = {"u": "m s-1", "v": "m s-1", "w": "m s-1", "ts": "K", "ta": "K", "t_cell": "K", "p_air": "Pa", "p_cell": "Pa"}


def canonical_unit(name: str, cfg: Config) -> str:
    if name in UNITS:
        return UNITS[name]
    return "mol m-3" if cfg.reported[name] == "molar_density" else "mol mol-1"


def from_dataframe(df: DataFrame, cfg: Config, order: tuple[str, ...] = ("key_us",)) -> DataFrame:
    """Cut samples from a frame with key_us (long microseconds) and series in canonical units.

    A series of another type than double or float, or whose field metadata names another unit, is
    refused. Values that aren't finite become NULL.
    """
    if "key_us" not in df.columns or not isinstance(df.schema["key_us"].dataType, T.LongType):
        raise ReadError("the frame needs key_us, a long of microseconds since 1970")
    found = [f for f in df.schema.fields if f.name in SERIES]
    for f in found:
        if not isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            raise ReadError(f"column {f.name} is {f.dataType.simpleString()}, not double")
        unit = (f.metadata or {}).get("unit")
        if unit is not None and unit != canonical_unit(f.name, cfg):
            raise ReadError(f"column {f.name} is in {unit}, not {canonical_unit(f.name, cfg)}")
    return cut_periods(df.withColumns({f.name: fin(F.col(f.name).cast("double")) for f in found}), cfg, order)


def to_dataframe(samples: DataFrame, cfg: Config) -> DataFrame:
    """Samples with a time column rebuilt as period start + i / frequency, and units as metadata."""
    step = 1e6 / cfg.period.acquisition_frequency
    t = F.timestamp_micros(F.col("period_start_us") + F.round(F.col("i") * F.lit(step)).cast("long")).cast("timestamp_ntz")
    rest = [F.col(c) for c in samples.columns if c not in SERIES]
    return samples.select(*rest, *[F.col(n).alias(n, metadata={"unit": canonical_unit(n, cfg)}) for n in SERIES if n in samples.columns], t.alias("time"))

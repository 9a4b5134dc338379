"""Runs the steps in order and publishes the 62-column table."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import SERIES, Config
from ..errors import StepError
from ..operators import periods, samples
from ..operators.common import INDEX, PERIOD, keys
from ..operators.fused import fused
from ..operators.lag import apply_lags
from ..operators.moments import summarise
from ..operators.thermo import thermodynamics
from ..schema import COLUMNS, FLAGS, SCALE, TIMESTAMPS

Step = Callable[[DataFrame, Config], DataFrame]

SAMPLE_STEPS: dict[str, Step] = {
    "cell": samples.convert_cell,
    "despike": samples.despike,
    "rotate": samples.rotate,
    "lag": apply_lags,
    "thermodynamics": thermodynamics,
    "detrend": samples.detrend,
}
PERIOD_STEPS: dict[str, Step] = {"assemble": periods.assemble, "wpl": periods.wpl, "spectral": periods.spectral, "qc": periods.itc}


def first_periods(df: DataFrame, n: int) -> DataFrame:
    """The samples of the first n periods: the limit is on the period list, then a semi-join."""
    by = keys(df)
    return df.join(df.select(*by).distinct().orderBy(PERIOD, *by).limit(n), by, "left_semi")


def run(df: DataFrame, cfg: Config, strategy: str = "arrow", limit: int | None = None, sample_steps: Sequence[Step] = (), period_steps: Sequence[Step] = ()) -> DataFrame:
    """One row per period with every figure, from cut samples. Further steps come after the built-in
    ones of their kind. ``arrow`` runs despiking, rotation and lag search in one numpy pass per
    period, ``native`` as window functions and joins."""
    if limit is not None:
        df = first_periods(df, limit)
    if strategy == "arrow":
        df = samples.detrend(thermodynamics(fused(samples.convert_cell(df, cfg), cfg), cfg), cfg)
    else:
        for name, step in SAMPLE_STEPS.items():
            df = step(df, cfg, strategy) if name == "lag" else step(df, cfg)
    for step in sample_steps:
        df = step(df, cfg)
    p = summarise(df, cfg)
    for step in (*PERIOD_STEPS.values(), *period_steps):
        p = step(p, cfg)
    stamp = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return p.withColumns({"period_start": stamp(F.col(PERIOD) - cfg.window_us), "period_end": stamp(F.col(PERIOD))})


def publish(p: DataFrame, cfg: Config) -> DataFrame:
    """The 62 columns in order, scaled, with their units as metadata; what is missing is NULL."""
    out = [F.col("site")] if "site" in p.columns else []
    for name, source, unit in COLUMNS:
        c = F.col(source) if source in p.columns else F.lit(None).cast("double")
        if source in SCALE:
            c = c * SCALE[source]
        if source in FLAGS:
            c = c.cast("int")
        elif source not in TIMESTAMPS and source in p.columns and p.schema[source].dataType == T.DoubleType():
            c = F.when(F.abs(c) < F.lit(float("inf")), c)
        out.append(c.alias(name, metadata={"unit": unit}))
    return p.select(*out)


def apply_step(step: str | Step, df: DataFrame, cfg: Config) -> DataFrame:
    """One step on a frame of one's own; checks types first. A name or any callable."""
    if isinstance(step, str):
        known = SAMPLE_STEPS | PERIOD_STEPS
        if step not in known:
            raise StepError(f"{step!r} is not a step; known are {', '.join(known)}")
        step = known[step]
    for f in df.schema.fields:
        if f.name in SERIES and not isinstance(f.dataType, (T.DoubleType, T.FloatType, T.NullType)):
            raise StepError(f"column {f.name} is {f.dataType.simpleString()}, not double")
    return step(df, cfg)


def user_step(function: Callable[[dict[str, object], Config], dict[str, object]], schema: str | T.StructType) -> Step:
    """A step from a function of one period's numpy arrays (by column name), run where the period is.

    If the function raises, that is logged and its period goes on without the step: columns that the
    period has stay, the schema's others are missing.
    """

    def step(df: DataFrame, cfg: Config) -> DataFrame:
        wanted = to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)

        def each(table: pa.Table) -> pa.Table:
            if INDEX in table.column_names:
                table = table.sort_by(INDEX)
            try:
                got = function({n: table.column(n).to_numpy(zero_copy_only=False) for n in table.column_names}, cfg)
                return pa.table(dict(got))
            except Exception:
                logging.getLogger(__name__).exception("a step failed; its period goes on without it")
            if INDEX in table.column_names and INDEX not in wanted.names:
                table = table.slice(0, 1)  # the step makes one row of a period's samples
            return pa.table([table.column(f.name).cast(f.type) if f.name in table.column_names else pa.nulls(table.num_rows, f.type) for f in wanted], names=wanted.names)

        return df.groupBy(*keys(df)).applyInArrow(each, schema)

    return step


def summary(p: DataFrame, cut: DataFrame | None = None, min_samples: int = 0) -> DataFrame:
    """One row: periods, samples, duplicates, spectral factors above what is plausible.

    With ``cut``, the samples cut without a least number, also skipped_short, the periods that have
    fewer than ``min_samples``, and rows, all samples that came in.
    """
    from ..constants import IMPLAUSIBLE_FACTOR

    high = [F.coalesce(F.col(x) > IMPLAUSIBLE_FACTOR, F.lit(False)) for x in ("scf_co2", "scf_h2o")]
    out = p.agg(F.count(F.lit(1)).alias("periods"), F.sum("n_in").alias("samples"), F.sum("n_dup").alias("duplicates"), F.count_if(high[0] | high[1]).alias("warnings"))
    if cut is None:
        return out
    each = cut.groupBy(*keys(cut)).agg(F.first("n_in").alias("n"), F.first("n_dup").alias("d"))
    return out.crossJoin(each.agg(F.count_if(F.col("n") < min_samples).alias("skipped_short"), F.sum(F.col("n") + F.col("d")).alias("rows")))  # one row each

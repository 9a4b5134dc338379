"""The sample clock is cut into periods on a grid anchored at the epoch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SERIES, Config
from ..operators.common import INDEX, PERIOD, SITE


def period_bounds(key: Column, window_us: int, closed: str = "right") -> tuple[Column, Column]:
    """(start, end) in whole microseconds; floor division, also before 1970.

    Right-closed periods own the sample on their end, left-closed ones that on their start; the
    label is the end either way.
    """
    k = key - 1 if closed == "right" else key
    start = k - F.pmod(k, F.lit(window_us).cast("long"))
    return start, start + window_us


def cut_periods(df: DataFrame, cfg: Config, order: tuple[str, ...] = ("key_us",)) -> DataFrame:
    """Samples with period_start_us, period_end_us, i, n_in and n_dup.

    ``df`` has key_us and any of the ten series; ``order`` is the order of arrival. Within a period a
    sample is kept only if its key exceeds every key before it, so repeats and backward samples both
    count as duplicates; with ``equal_stamps = keep`` a key that equals the one before is a sample of its
    own (sources where different samples share a stamp). Periods under ``min_samples`` go. Series that are not there are NULL, or the
    site's constant pressure. One shuffle, by period.
    """
    start, end = period_bounds(F.col("key_us"), cfg.window_us, cfg.period.closed)
    absent = {n: (F.lit(cfg.site.pressure_pa) if n == "p_air" else F.lit(None)).cast("double") for n in SERIES if n not in df.columns}
    df = df.withColumns({"period_start_us": start, PERIOD: end} | absent)
    by = [SITE, PERIOD] if SITE in df.columns else [PERIOD]
    arrival = Window.partitionBy(*by).orderBy(*order)
    before = F.max("key_us").over(arrival.rowsBetween(Window.unboundedPreceding, -1))
    keep = cfg.period.equal_stamps == "keep"
    df = df.withColumn("__kept", before.isNull() | (F.col("key_us") >= before if keep else F.col("key_us") > before))
    all_rows = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = F.count_if("__kept").over(all_rows)
    df = df.withColumns({"n_in": kept, "n_dup": F.count(F.lit(1)).over(all_rows) - kept}).where("__kept").drop("__kept")
    # Kept keys rise, so the key itself is the order of what is kept; among equal ones it is arrival.
    kept_order = order if keep else ("key_us",)
    df = df.withColumn(INDEX, F.row_number().over(Window.partitionBy(*by).orderBy(*kept_order)).cast("long") - 1)
    if cfg.period.min_samples > 0:
        df = df.where(F.col("n_in") >= cfg.period.min_samples)
    return df


def late_rows(df: DataFrame, cfg: Config) -> DataFrame:
    """Rows that belong to a period before one already seen in the stream (file_rank, lineno).

    Two levels, so that no partition holds the whole stream: the running latest period within a file,
    and the latest of all earlier files from one row per file.
    """
    _, end = period_bounds(F.col("key_us"), cfg.window_us, cfg.period.closed)
    df = df.withColumn(PERIOD, end)
    by = [SITE] if SITE in df.columns else []
    files = df.groupBy(*by, "file_rank").agg(F.max(PERIOD).alias("latest"))
    earlier = Window.partitionBy(*by).orderBy("file_rank").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(*by, "file_rank", F.max("latest").over(earlier).alias("before_file"))
    running = Window.partitionBy(*by, "file_rank").orderBy("lineno").rowsBetween(Window.unboundedPreceding, -1)
    seen = df.withColumn("before", F.max(PERIOD).over(running)).join(files, [*by, "file_rank"])
    return seen.where(F.col(PERIOD) < F.greatest(F.coalesce("before", "before_file"), F.coalesce("before_file", "before"))).drop("before", "before_file")

"""What the sample steps share: the period window and its aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..errors import StepError

SITE, PERIOD, INDEX = "site", "period_end_us", "i"


def keys(df: DataFrame) -> list[str]:
    """Grouping columns of a period."""
    return [SITE, PERIOD] if SITE in df.columns else [PERIOD]


def whole(df: DataFrame) -> WindowSpec:
    """The whole period. The frame's order by period and index serves it without a further sort."""
    return Window.partitionBy(*keys(df))


def over(df: DataFrame, *aggregates: Column) -> list[Column]:
    w = whole(df)
    return [a.over(w) for a in aggregates]


def need(df: DataFrame, step: str, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise StepError(f"{step} needs the columns {', '.join(missing)}")


def mask_where(flag: Column, x: Column) -> Column:
    """x where the flag isn't set."""
    return F.when(~F.coalesce(flag, F.lit(False)), x)

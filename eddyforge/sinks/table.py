"""Writers of the published table: one CSV with a units file beside it, or partitioned Parquet."""

from __future__ import annotations

import csv
import datetime
import math
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..schema import COLUMNS


def units_path(path: str) -> str:
    stem, _ = os.path.splitext(path)
    return f"{stem}_units.csv"


def render(value: object, na_value: str, float_format: str) -> str:
    """One cell; C number formats are Python's, which is why this runs on the driver."""
    if value is None or (isinstance(value, float) and not math.isfinite(value)):
        return na_value
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, datetime.datetime):
        return value.strftime("%Y%m%d%H%M")
    return float_format % value if isinstance(value, float) else str(value)


def write_csv(published: DataFrame, cfg: Config, path: str | None = None) -> int:
    """Writes rows in order of TIMESTAMP_END, CRLF line ends, and the units; returns the number.

    Rows come to the driver a partition at a time: one row per period, not per sample.
    """
    path = path or cfg.files.output_csv
    names = [n for n in published.columns]
    rows = 0
    with open(path, "w", encoding="utf-8", newline="") as f:
        out = csv.writer(f)
        out.writerow(names)
        for r in published.orderBy("TIMESTAMP_END", *[c for c in ("site",) if c in names]).toLocalIterator():
            out.writerow([render(r[n], cfg.output.na_value, cfg.output.float_format) for n in names])
            rows += 1
    with open(units_path(path), "w", encoding="utf-8", newline="") as f:
        out = csv.writer(f)
        out.writerow(["name", "unit"])
        out.writerows((n, u) for n, _, u in COLUMNS)
    return rows


def write_parquet(published: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet partitioned by the day of the period's end."""
    published.withColumn("day", F.to_date("TIMESTAMP_END")).write.mode(mode).partitionBy("day").parquet(path)

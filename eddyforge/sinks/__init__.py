"""The published table as files."""

from .table import render, units_path, write_csv, write_parquet

__all__ = ["render", "units_path", "write_csv", "write_parquet"]

"""A PySpark engine for flux-tower time series."""

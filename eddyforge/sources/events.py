"""A deterministic sample table computed from ``events``: daily periods with a planted lag of three
samples, planted spikes, and missing h2o and ta. Different events may share a microsecond: each is a
sample, in order of event_id, where the configuration keeps equal stamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DAY = 86_400_000_000

#: Signals as SQL over e(event_id, key_us, user_id, event_type, value, g, period_end_us, g3); the same
#: text is valid in Spark and DuckDB. Double literals keep decimals out.
SIGNALS = {
    "u": "2.0e0 - 0.56e0*g + 0.02e0*((user_id % 31) - 15) + CASE WHEN event_id % 97 = 13 THEN 40e0 ELSE 0e0 END",
    "v": "-0.2e0 + 0.02e0*((event_id*37) % 41 - 20)",
    "w": "0.05e0 + 0.7e0*g",
    "ts": "293.15e0 + 0.6e0*g + 0.01e0*(value-50e0)",
    "ta": "CASE WHEN event_type = 'error' THEN NULL ELSE 291e0 + 0.5e0*g END",
    "p_air": "99000e0 + 10e0*(user_id % 7)",
    "co2": "420e-6 - 6e-6*g3 + 2e-8*(value-50e0) + CASE WHEN event_id % 211 = 5 THEN 1e-3 ELSE 0e0 END",
    "h2o": "CASE WHEN event_id % 53 = 7 THEN NULL ELSE 0.012e0 + 3e-4*g END",
    "t_cell": "298.15e0 + 0.01e0*(event_id % 97)",
    "p_cell": "99300e0 + 1e0*(event_id % 61)",
}
G3 = "lag(g, 3) OVER (PARTITION BY period_end_us ORDER BY event_id)"
PERIOD = f"(key_us-1) - ((key_us-1) % {DAY}) + {DAY}"


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, key_us and the ten series, before the cut. The planted lag is within a period, so
    its window is partitioned."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id", "unix_micros(CAST(ts AS TIMESTAMP)) AS key_us", "user_id", "event_type", "value", "(CAST(get_json_object(props,'$.k') AS INT) - 49.5e0)/50e0 AS g"
    )
    e = e.selectExpr("*", f"{PERIOD} AS period_end_us").selectExpr("*", f"{G3} AS g3")
    return e.selectExpr("event_id", "key_us", *[f"{sql} AS {name}" for name, sql in SIGNALS.items()])


def event_samples(spark: SparkSession, sf_dir: str, cfg) -> DataFrame:
    from .frame import from_dataframe

    return from_dataframe(event_rows(spark, sf_dir), cfg, ("key_us", "event_id"))
